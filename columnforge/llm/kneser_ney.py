"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, so it also reads words that it has never seen, and over the whole of Unicode: an n-gram
of ORDER symbols is its first code point and the others packed into one long, without hashing or a cap. A code beyond Unicode
marks a text's beginning.

All trusted text is counted, in two halves by the hash of the text; each half gives a model, and a document is judged by
that of the half that it is not in, as a model knows the texts that it was trained on too well. So trusted and other
documents are judged alike. Each task adds up its n-grams; they are summed in shards by n-gram, and the continuation counts,
context totals, counts of counts, discounts, probabilities and back-off weights of each order are joins and aggregates over
those shards. The model stays a sharded table that grows with the corpus.

Scoring joins counts, not texts: the rows of a file are parted in blocks of BLOCK_ROWS, the distinct n-grams of each block are
joined with the model's shards, and what is found comes back as one row a block, in files of the shared folder, sorted by block. The
documents are then read a second time, each block with its own row of the model, and their text never moves. Blocks are
known by file and row, so that both readings have the same; documents that come from no file are written first.

Of the documents' text only that of trusted ones is moved, to be joined with their labels: a Bloom
filter of bounded size over their ids (_filter) leaves out most others before.

The threshold of a language is a quantile of the perplexities of its trusted documents, times a margin. For this a
document's perplexity is drawn towards the language's mean as by PSEUDO more characters, so that short
texts are not rejected by chance. How far the quantile lies above the language's mean (in logarithms) is drawn towards
the same of all trusted documents, each against the mean of its own language, as by SHRINK more documents: one rule for
any number of them, in which no language is held to the level of another.

Defined cases: null and empty text has no perplexity (null) and is kept; a null language is a language of its own;
without trusted text, of a language or at all, its documents are kept (threshold null); where all trusted text is in one
half, both models are of all of it; labels without a document, null labels and repeated labels are
ignored; repeated rows are judged alike; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._filter import Filter
from ._shared import new_path, stage
from ._text import chunks

ORDER = 4
QUANTILE = 0.99
MARGIN = 1.01
PSEUDO = 100
SHRINK = 20
BLOCK_ROWS = 8192
#: No discount is less, so that what a small text lacks keeps some probability.
LEAST = 0.1
#: Distinct n-grams that a task holds before it puts them out.
HELD = 1 << 21
STEP = 1 << 20
BITS = 21
EDGE = (1 << BITS) - 1
_ONE, _TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled as of good quality and not toxic."""
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("doc_id IS NOT NULL AND q = 1 AND t = 0").select("doc_id")


def trusted(docs: DataFrame, good: DataFrame) -> DataFrame:
    """text of the documents (doc_id, text) whose id is in `good`, a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    rows = Filter(good, "doc_id").keep(rows, "doc_id")
    # ids in `good` are distinct; a semi-join would be moved below the filter
    return rows.join(good.hint("merge"), "doc_id").select("text")


def _half(text: Column | str = "text") -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def _points(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with ORDER - 1 edges before each text, the texts' places in it, their lengths."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    size = np.asarray(pc.utf8_length(text), np.int64)
    points = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(size)
    edges = ORDER - 1
    return np.insert(points, np.repeat(ends - size, edges), EDGE), ends - size + edges * np.arange(1, len(size) + 1), size


def _windows(points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """In steps: the first place, which places are characters, and of these the n-gram: first code point, packed others."""
    for lo in range(ORDER - 1, len(points), STEP):
        p = points[lo - ORDER + 1 : lo + STEP].astype(np.int64)
        real = p[3:] != EDGE
        yield lo, real, p[:-3][real], (p[1:-2] << 2 * BITS | p[2:-1] << BITS | p[3:])[real]


def _distinct(first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams, and the number of each given one's."""
    code, found = pd.factorize(rest)
    code, keys = pd.factorize(code.astype(np.int64) << BITS | first)
    return keys & _ONE, found[keys >> BITS], code


def _summed(first: np.ndarray, rest: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Equal n-grams as one, with the sums of their counts."""
    first, rest, code = _distinct(first, rest)
    return [first, rest, *(np.bincount(code, c, len(first)).astype(np.int64) for c in counts)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []

    def out() -> pa.RecordBatch:
        whole = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held[:] = [whole]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (whole[0].astype(np.int32), *whole[1:])], ["first", "rest", "c0", "c1"])

    for part in chunks(batches, "text"):
        points, at, size = _points(part.column("text"))
        half = np.zeros(len(points), np.int8)
        half[at[0] - ORDER + 1 :] = np.repeat(part.column("half").to_numpy(), size + ORDER - 1)
        for lo, real, first, rest in _windows(points):
            own = half[lo : lo + len(real)][real]
            held.append(_summed(first, rest, own == 0, own == 1))
        if sum(len(x[0]) for x in held) > HELD:
            batch = out()
            if batch.num_rows > HELD // 2:
                yield batch
                held.clear()
    if held:
        yield out()


def counts_of(text: DataFrame) -> DataFrame:
    """(first, rest, c0, c1): how often each n-gram occurs in the column `text`, in the texts of each half; a table in shards."""
    made = text.select("text", _half().alias("half")).mapInArrow(_count, "first int, rest long, c0 long, c1 long")
    return made.groupBy("first", "rest").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


@dataclass
class Model:
    """Rows (first, rest, p0, p1, b0, b1) in shards: log-probabilities and back-off weights of both models; `first` is -k for n-grams of k < ORDER symbols.

    roots: the log-probability of a character never seen.
    """

    rows: DataFrame
    roots: tuple[float, float]


def _discounts(counts: DataFrame) -> tuple[list[float], list[float]]:
    """D1, D2, D3+ of each half, from the numbers of n-grams that occur once to four times."""
    n = counts.agg(*(F.count_if(F.col(f"c{h}") == k).alias(f"n{h}{k}") for h in (0, 1) for k in range(1, 5))).first()
    out = []
    for h in (0, 1):
        have = [n[f"n{h}{k}"] for k in range(1, 5)]
        y = have[0] / (have[0] + 2 * have[1]) if have[0] and have[1] else 0.5
        out.append([min(max(k - (k + 1) * y * have[k] / have[k - 1], LEAST), float(k)) if have[k - 1] and have[k] else min(0.5 * k, 1.0) for k in (1, 2, 3)])
    return out[0], out[1]


def model_of(counts: DataFrame) -> Model | None:
    """The models of both halves from `counts`, a written table; None if it is empty."""
    sums = counts.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).first()
    if sums.c0 is None:
        return None
    if not sums.c0 or not sums.c1:
        counts = counts.select("first", "rest", *((F.col("c0") + F.col("c1")).alias(c) for c in ("c0", "c1")))
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):  # the shorter n-grams: in how many different ones of the next order each ends
        rest = F.col("rest").bitwiseAND(F.lit((1 << k * BITS) - 1))
        orders.append(stage(orders[-1].groupBy(rest.alias("rest")).agg(*(F.count_if(F.col(c) > 0).alias(c) for c in ("c0", "c1"))), f"grams-{k}"))
    orders.reverse()
    # of one symbol: a single context, and the uniform distribution over the characters and one more below it
    symbols = orders[0].count() + 1
    d = _discounts(orders[0])
    off = lambda h: F.when(F.col(f"c{h}") == 0, 0.0).when(F.col(f"c{h}") == 1, d[h][0]).when(F.col(f"c{h}") == 2, d[h][1]).otherwise(d[h][2])
    total = orders[0].agg(*(F.sum(f"c{h}").alias(f"t{h}") for h in (0, 1)), *(F.sum(off(h)).alias(f"d{h}") for h in (0, 1))).first()
    base = [total[f"d{h}"] / total[f"t{h}"] / symbols for h in (0, 1)]
    prob = stage(orders[0].select("rest", *(F.when(F.col(f"c{h}") > 0, (F.col(f"c{h}") - off(h)) / total[f"t{h}"] + base[h]).alias(f"p{h}") for h in (0, 1))), "probabilities-1")
    parts = []
    for k in range(2, ORDER + 1):
        d = _discounts(orders[k - 1])
        shorter = F.col("rest") if k == ORDER else F.col("rest").bitwiseAND(F.lit((1 << (k - 1) * BITS) - 1))
        context = F.shiftright("rest", BITS)
        context = context if k < ORDER else context.bitwiseOR(F.call_function("shiftleft", F.col("first").cast("long"), F.lit(2 * BITS)))
        own = ["first", "rest"] if k == ORDER else ["rest"]
        keyed = orders[k - 1].select(*own, "c0", "c1", context.alias("context"), shorter.alias("shorter"))
        sums = stage(keyed.groupBy("context").agg(*(F.sum(f"c{h}").alias(f"t{h}") for h in (0, 1)), *(F.sum(off(h)).alias(f"d{h}") for h in (0, 1))), f"contexts-{k}")
        weight = [F.col(f"d{h}") / F.col(f"t{h}") for h in (0, 1)]
        below = prob.select(F.col("rest").alias("shorter"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        value = [F.when(F.col(f"c{h}") > 0, (F.col(f"c{h}") - off(h)) / F.col(f"t{h}") + weight[h] * F.col(f"q{h}")).alias(f"p{h}") for h in (0, 1)]
        logs = [F.log(f"p{h}").cast("float").alias(f"p{h}") for h in (0, 1)]
        back = sums.select(F.col("context").alias("rest"), *(F.when(F.col(f"t{h}") > 0, F.log(weight[h])).cast("float").alias(f"b{h}") for h in (0, 1)))
        parts.append(prob.select("rest", *logs).join(back.hint("merge"), "rest", "full").select(F.lit(1 - k).alias("first"), "rest", "p0", "p1", "b0", "b1"))
        prob = stage(keyed.join(sums.hint("merge"), "context").join(below.hint("merge"), "shorter").select(*own, *value), f"probabilities-{k}")
    none = F.lit(None).cast("float")
    rows = prob.select("first", "rest", *logs, none.alias("b0"), none.alias("b1"))
    for part in parts:
        rows = rows.unionAll(part)
    return Model(stage(rows, "model"), (math.log(base[0]), math.log(base[1])))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of all orders that each block's texts need."""
    block, held, size = None, [], 0

    def out() -> pa.RecordBatch:
        first, rest = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        prefix = first << 2 * BITS | rest >> BITS
        keys = [(first, rest)]
        for k, (a, b) in enumerate(((rest & _ONE, prefix & _ONE), (rest & _TWO, prefix & _TWO), (rest, prefix)), 1):
            found = np.unique(np.concatenate((a, b)))
            keys.append((np.full(len(found), -k), found))
        first, rest = (np.concatenate(x) for x in zip(*keys, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), block)), pa.array(first.astype(np.int32)), pa.array(rest)], ["block", "first", "rest"])

    for name, part in _blocks(batches, 0, 1):
        if held and (name != block or size > HELD):
            yield out()
            size = 0
        block = name
        for _, _, first, rest in _windows(_points(part.column(1))[0]):
            held.append(_summed(first, rest))
            size += len(held[-1][0])
    if held:
        yield out()


def _blocks(batches: Iterator[pa.RecordBatch], block: int, text: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of bounded text, each of one block."""
    for batch in batches:
        name = batch.column(block).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), batch.num_rows] if len(name) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            rows = pa.RecordBatch.from_arrays([part.column(text).cast(pa.string()), pa.array(np.arange(b - a))], ["text", "row"])
            for piece in chunks(iter([rows]), "text"):
                yield name[a], part.slice(piece.column("row")[0].as_py(), piece.num_rows)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block, of rows sorted by block: its n-grams and their values as bytes, equal ones once."""
    names = ["p0", "p1", "b0", "b1"]
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        first, rest = rows["first"].to_numpy(), rows["rest"].to_numpy()
        order = np.lexsort((first, rest))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(first[order]) != 0) | (np.diff(rest[order]) != 0)
        order = order[new]
        value = np.stack([pc.fill_null(rows[c], float("nan")).to_numpy()[order] for c in names], axis=1).astype(np.float32)
        return pa.RecordBatch.from_arrays([rows["shard"].combine_chunks().slice(0, 1), rows["block"].combine_chunks().slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in (first[order].astype(np.int32), rest[order], value))], ["shard", "block", "first", "rest", "value"])

    for batch in batches:
        name = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)] if len(name) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column("block")[0].as_py() != name[a]:
                yield out()
                held.clear()
            held.append(batch.slice(a, b - a))
    if held:
        yield out()


class Lookup:
    """What the models know of a block's n-grams."""

    def __init__(self, row: dict | None, roots: tuple[float, float]) -> None:
        self.roots = np.array(roots, np.float32)
        first = np.frombuffer(row["first"] if row else b"", np.int32).astype(np.int64)
        rest = np.frombuffer(row["rest"] if row else b"", np.int64)
        value = np.frombuffer(row["value"] if row else b"", np.float32).reshape(-1, 4)
        self.short = {k: (rest[first == -k], value[first == -k]) for k in range(1, ORDER)}
        own = first >= 0
        self.rests, code = np.unique(rest[own], return_inverse=True)
        keys = code.astype(np.int64) << BITS | first[own]
        order = np.argsort(keys)
        self.keys, self.full = keys[order], value[own][order]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _values(self, k: int, wanted: np.ndarray, columns: slice) -> np.ndarray:
        keys, value = self.short[k]
        at, have = self._find(keys, wanted)
        out = np.full((len(wanted), 2), np.nan, np.float32)
        out[have] = value[at[have], columns]
        return out

    def logs(self, first: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """(n, 2): ln p of each n-gram's last symbol after the others, by both models."""
        prefix = first << 2 * BITS | rest >> BITS
        p = self._values(1, rest & _ONE, slice(0, 2))
        out = np.where(np.isnan(p), self.roots, p)
        for k, (gram, context) in enumerate(((rest & _TWO, prefix & _ONE), (rest, prefix & _TWO), (None, prefix)), 2):
            if gram is None:
                at, have = self._find(self.rests, rest)
                at, same = self._find(self.keys, at << BITS | first)
                have &= same
                p = np.full((len(rest), 2), np.nan, np.float32)
                p[have] = self.full[at[have], :2]
            else:
                p = self._values(k, gram, slice(0, 2))
            out = np.where(np.isnan(p), np.nan_to_num(self._values(k - 1, context, slice(2, 4))) + out, p)
        return out

    def score(self, text: pa.Array, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of -ln p by the model of the other half, and the number of characters, of each text."""
        points, at, size = _points(text)
        nll = np.zeros(len(size))
        model = np.zeros(len(points), np.int64)
        model[at[0] - ORDER + 1 :] = np.repeat(1 - half, size + ORDER - 1)
        for lo, real, first, rest in _windows(points):
            first, rest, code = _distinct(first, rest)
            logs = self.logs(first, rest)
            cost = np.zeros(len(real))
            cost[real] = -logs[code, model[lo : lo + len(real)][real]]
            sums = np.concatenate((np.zeros(1), np.cumsum(cost)))
            nll += sums[np.clip(at + size - lo, 0, len(real))] - sums[np.clip(at - lo, 0, len(real))]
        return nll, size


def _located(docs: DataFrame) -> DataFrame:
    """The documents with _block, a block of rows of one file; documents that come from no file are written first."""
    place = F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / BLOCK_ROWS)).alias("_block")
    if "_metadata" not in docs._jdf.queryExecution().analyzed().metadataOutput().toString():
        docs = stage(docs, "documents")
    return docs.select("*", place)


def score(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """The documents, all columns (without text, if so asked), with _nll and _chars, from the column text. Names that begin with _block, _half are taken."""
    spark = docs.sparkSession
    rows = _located(docs).withColumn("_half", F.coalesce(_half(F.col("text").cast("string")), F.lit(0)))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = rows.select("_block", F.col("text").cast("string").alias("text")).mapInArrow(_wanted, "block long, first int, rest long")
    found = wanted.join(model.rows.hint("merge"), ["first", "rest"]).withColumn("shard", F.pmod("block", F.lit(shards)).cast("int"))
    packed = found.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(_pack, "shard int, block long, first binary, rest binary, value binary")
    folder = new_path(spark, "lookups")
    packed.write.option("compression", "zstd").option("parquet.block.size", 1 << 20).option("parquet.block.size.row.check.min", 1).option("parquet.block.size.row.check.max", 1).partitionBy("shard").parquet(folder)
    roots, names = model.roots, rows.columns
    block, half, text = (names.index(c) for c in ("_block", "_half", "text"))
    kept = [k for k, c in enumerate(names) if k not in (block, half) and (keep_text or k != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lookup = None, None
        for name, part in _blocks(batches, block, text):
            if name != now:
                now, lookup = name, Lookup(_load(folder, int(name), int(name) % shards), roots)
            nll, size = lookup.score(part.column(text).cast(pa.string()), part.column(half).to_numpy())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(nll), pa.array(size)], [*(names[k] for k in kept), "_nll", "_chars"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema.fields[k] for k in kept), T.StructField("_nll", T.DoubleType()), T.StructField("_chars", T.LongType())]))


def _load(folder: str, block: int, shard: int) -> dict | None:
    """A block's row of n-grams; None if the models know none of them."""
    store, inner = fs.FileSystem.from_uri(f"{folder}/shard={shard}")
    if store.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    found = dataset.dataset(inner, filesystem=store, format="parquet").to_table(columns=["first", "rest", "value"], filter=dataset.field("block") == block)
    return found.to_pylist()[0] if found.num_rows else None


def _drawn(mean: Column) -> Column:
    return F.exp((F.col("_nll") + PSEUDO * mean) / (F.col("_chars") + PSEUDO))


def thresholds(rows: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(language, mean, threshold) of each language in rows (lang, _nll, _chars): mean of -ln p, and the highest perplexity that is kept."""
    means = stage(rows.groupBy("lang").agg((F.sum("_nll") / F.sum("_chars")).alias("mean"), F.count("*").alias("n")), "means")
    over = rows.alias("r").join(means.alias("m"), F.col("r.lang").eqNullSafe(F.col("m.lang"))).select("m.lang", "mean", "n", (F.log(_drawn(F.col("mean"))) - F.col("mean")).alias("over"))
    at = F.percentile_approx("over", quantile, 100_000)
    whole = over.agg(at).first()[0]
    own = over.groupBy("lang", "mean", "n").agg(at.alias("over"))
    cut = F.exp(F.col("mean") + (F.col("n") * F.col("over") + SHRINK * F.lit(whole)) / (F.col("n") + SHRINK)) * margin
    return stage(own.select(F.col("lang").alias("language"), "mean", cut.alias("threshold")), "thresholds")


def _judged(docs: DataFrame, labels: DataFrame, keep_text: bool) -> tuple[DataFrame, list[Column]]:
    """Documents under names of their own with what was found, and their columns under the old names."""
    inner = [c if c in ("doc_id", "text", "lang") else f"_{k}" for k, c in enumerate(docs.columns)]
    own, back = docs.toDF(*inner), [F.col(a).alias(b) for a, b in zip(inner, docs.columns, strict=True) if keep_text or a != "text"]
    good = stage(good_ids(labels), "good")
    model = model_of(stage(counts_of(trusted(docs, good)), "grams"))
    if model is None:
        return own.select("*", *(F.lit(None).cast("double").alias(c) for c in ("_perplexity", "_drawn", "_cut")), F.lit(True).alias("_kept")), back
    scored = stage(score(own, model, keep_text), "scored")
    marked = scored.where("_chars > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "_nll", "_chars")
    cuts = thresholds(stage(marked.join(good.hint("merge"), "doc_id", "left_semi"), "trusted"))
    some = F.col("_chars") > 0
    out = scored.join(cuts, F.col("lang").cast("string").eqNullSafe(F.col("language")), "left")
    out = out.withColumn("_cut", F.col("threshold")).withColumn("_drawn", F.when(some, _drawn(F.col("mean")))).withColumn("_perplexity", F.when(some, F.exp(F.col("_nll") / F.col("_chars"))))
    return out.withColumn("_kept", ~some | F.col("_cut").isNull() | (F.col("_drawn") <= F.col("_cut"))), back


def classify(docs: DataFrame, labels: DataFrame, keep_text: bool = True) -> DataFrame:
    """The documents, all columns (without text, if so asked), with perplexity, drawn (perplexity as compared), threshold, kept."""
    out, back = _judged(docs, labels, keep_text)
    return out.select(*back, F.col("_perplexity").alias("perplexity"), F.col("_drawn").alias("drawn"), F.col("_cut").alias("threshold"), F.col("_kept").alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that are kept."""
    out, back = _judged(docs, labels, True)
    return out.where("_kept").select(*back)
