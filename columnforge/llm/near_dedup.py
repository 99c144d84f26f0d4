"""MinHash near-dedup with a fast similarity sketch, banding and exact verification.

The sketch has T coordinates, filled in rounds. In each of the first T rounds every element of the set is
hashed to one coordinate; in the T rounds after them every element goes to one fixed coordinate. A coordinate
keeps the smallest value of the first round that reaches it, and the sketch is done once all are filled.
So it costs about T log T steps, however small the set, and estimates the Jaccard similarity with the
concentration of full MinHash. Bands of ROWS coordinates give the candidates: a pair at the threshold of 0.75
shares none of the 32 bands with probability (1 - 0.75^4)^32 = 5e-6.

Documents of one equal set are a class; only one of each class goes on. Pairs within a bucket are never
put out as rows: each document is verified with one leader of its buckets on full sets, and components are formed. In
buckets that still hold several components, the sets of different components are compared block by block inside
tasks, exactly, and only what joins components comes out. So every pair that shares a bucket is either in one
component or compared.

Defined cases: null or wordless text has an empty set, linked with nothing; fewer words than five are one
shingle; repeated rows are one class; an id that occurs with several texts is one
node with several sets; a row with a null id is a component of its own (component_id null, kept
true); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from ._shared import stage
from ._text import IN_TOKEN, LOWER, U64, chunks, mix, text_bytes, word_hashes, words

SHINGLE = 5
PERCENT = 75
T = 128
ROWS = 4
BANDS = T // ROWS
#: Pairs whose sketches agree in fewer coordinates than this are not verified: at a similarity of 0.75 the
#: agreement has mean 96 and deviation 4.9, so 66 is six deviations below.
AGREE = 66


def shingle_sets(text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and n + 1 offsets."""
    buf, at = text_bytes(text)
    buf = LOWER[buf]
    starts, ends, ptr = words(buf, at, IN_TOKEN)
    h, n = word_hashes(buf, starts, ends), len(at) - 1
    many = np.diff(ptr)
    count = np.where(many >= size, many - size + 1, np.minimum(many, 1))
    owner = np.repeat(np.arange(n), count)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    first = ptr[:-1][owner] + np.arange(len(owner)) - begin[owner]
    left = np.minimum(many[owner], size)
    value = np.zeros(len(owner), U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            more = np.flatnonzero(left > k)
            value[more] = mix(value[more] * U64(0x9E3779B97F4A7C15) + h[first[more] + k] + U64(k + 1))
    order = np.lexsort((value, owner)) if len(owner) else np.zeros(0, np.int64)
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int64)


def sketches(value: np.ndarray, ptr: np.ndarray, t: int = T) -> np.ndarray:
    """An (n, t) array: the sketch of each set; all ones for empty sets."""
    n = len(ptr) - 1
    empty = np.iinfo(np.uint64).max
    out = np.full(n * t, empty, U64)
    size = np.diff(ptr)
    owner = np.repeat(np.arange(n), size)
    live = np.ones(len(value), bool)
    for i in range(2 * t):
        if not len(value):
            break
        with np.errstate(over="ignore"):
            x = mix(value + U64(((i + 1) * 0xA0761D6478BD642F) & ((1 << 64) - 1)))
        place = owner * t + ((x & U64(0xFFFFFFFF)) % U64(t) if i < t else U64(i - t)).astype(np.int64)
        # the round leads, so what an earlier round has put stays
        np.minimum.at(out, place, (U64(i) << U64(48)) | (x >> U64(16)))
        full = (out.reshape(n, t) != empty).all(axis=1)
        live = ~full[owner]
        value, owner = value[live], owner[live]
    return out.reshape(n, t)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        value, ptr = shingle_sets(part.column("text"))
        n = part.num_rows
        size = np.diff(ptr)
        sk = sketches(value, ptr)
        a, b = _sums(mix(value), ptr), _sums(mix(value ^ U64(0x5851F42D4C957F2D)), ptr)
        with np.errstate(over="ignore"):
            keys = np.zeros((n, BANDS), U64)
            for k in range(ROWS):
                keys = mix(keys + sk[:, k::ROWS] + U64(k))
            keys = mix(keys + np.arange(BANDS, dtype=U64))
        have = np.where(size > 0, BANDS, 0)
        bands = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(have))).astype(np.int32), pa.array(keys[size > 0].reshape(-1).view(np.int64)))
        small = pa.array([x.tobytes() for x in (mix(sk) >> U64(56)).astype(np.uint8)], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), bands, small], ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        value, ptr = shingle_sets(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_sums(mix(value), ptr).view(np.int64)), pa.ListArray.from_arrays(ptr.astype(np.int32), pa.array(value.view(np.int64)))], ["doc_id", "fp1", "shingles"])


def _sums(value: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(value, dtype=U64)))
    with np.errstate(over="ignore"):
        return total[ptr[1:]] - total[ptr[:-1]]


def _agreement(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree often enough; equal bytes by chance add to it, so none is lost."""
    for part in pairs:
        a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, T) for c in ("sketch_a", "sketch_b"))
        ok = np.flatnonzero((a == b).sum(axis=1) >= AGREE)
        yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(ok)) for c in ("a", "b")], ["a", "b"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the nodes in edges (a, b): the smallest node that each reaches.

    Each round hangs a whole component on the smallest label next to it and then follows labels of labels;
    all in joins and partial aggregates, each round's result written to the shared folder.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    now = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("c")), name)
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("near"))
        step = stage(now.join(near, "node").select("node", "c", F.least("c", "near").alias("near")), name)
        lift = step.groupBy("c").agg(F.min("near").alias("up"))
        hung = step.join(lift, "c").select("node", F.col("c").alias("old"), F.least("near", "up").alias("c"))
        jump = hung.select(F.col("node").alias("c"), F.col("c").alias("next"))
        new = stage(hung.join(jump, "c", "left").select("node", "old", F.least("c", "next").alias("c")), name)
        now = new.select("node", "c")
        if new.where("c <> old").isEmpty():
            return now.withColumnRenamed("c", "component")


def duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = stage(docs.mapInArrow(_profile, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"), "profile")
    fp = ["fp1", "fp2", "n_shingles"]
    real = profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # written, so that both sides of the joins below are dealt out for them and a hot class can be split
    classes = stage(real.groupBy(*fp).agg(F.min("doc_id").alias("rep")), "classes")
    # ids that occur with several sets tie their classes together
    tied = real.groupBy("doc_id").agg(F.min("fp1").alias("x"), F.max("fp1").alias("y")).where("x <> y").select("doc_id")
    members = stage(profile.select("doc_id", *fp).join(classes, fp, "left"), "members")
    ties = members.join(tied, "doc_id").where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = stage(profile.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *fp], "left_semi").dropDuplicates(["doc_id", *fp]), "representatives")
    rows = reps.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    buckets = stage(rows.join(shared.select("bucket"), "bucket", "left_semi"), "buckets")
    # the member of a bucket that shares most with others leads it, so that a family's buckets mostly have one leader
    weight = stage(buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("size")), "bucket").groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    led = stage(buckets.join(weight, "node").groupBy("bucket").agg(F.max_by("node", "weight").alias("head"), F.max("weight").alias("weight")), "leaders")
    sets = _stored_sets(docs, reps, buckets)
    # each document is first compared with one leader, the heaviest of all its buckets
    pairs = buckets.join(led, "bucket").groupBy(F.col("node").alias("a")).agg(F.max_by("head", "weight").alias("b")).where("a <> b")
    short = reps.select(F.col("doc_id").alias("node"), "sketch")
    near = pairs.join(short.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(short.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    near = stage(near.mapInArrow(_agreement, "a long, b long").distinct(), "candidates")
    links = ties.distinct().union(_verified(sets, near, percent))
    comp = components(stage(links, "links"))
    more = stage(_across(buckets, led, comp, sets, percent), "more-links")
    if not more.isEmpty():
        # between components; their labels stand for their members
        joined = components(more, "joined").select(F.col("node").alias("component"), F.col("component").alias("into"))
        nodes = comp.select("node", "component").union(joined.select(F.col("component").alias("node"), "component")).distinct()
        comp = stage(nodes.join(joined, "component", "left").groupBy("node").agg(F.min(F.coalesce("into", "component")).alias("component")), "merged")
    out = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    mine = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), mine).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, one of each group of near copies: the one with the smallest id.

    Rows without an id stay. Rows that share an id but not the text are documents of their own, and come after all others in the
    order; of rows that share both, the one with the smallest hash of its columns stays.
    """
    inner = [c if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)]
    name = inner[docs.columns.index("doc_id")]
    own, back = docs.toDF(*inner), [F.col(a).alias(b) for a, b in zip(inner, docs.columns, strict=True)]
    own = own.withColumns({"_id": F.col(name).cast("long"), "_h": F.xxhash64(F.col("text").cast("string"))})
    seen = own.where("_id IS NOT NULL").groupBy("_id").agg(F.count("*").alias("n"), F.min("_h").alias("x"), F.max("_h").alias("y")).where("n > 1")
    twice = stage(seen.select("_id", (F.col("x") != F.col("y")).alias("_several")), "repeated")
    own = own.withColumn("_node", F.col("_id"))
    if again := not twice.isEmpty():
        # two bits of the hash make way for the place in the order
        last = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("_id", "_h"), 2))
        own = own.drop("_node").join(twice, "_id", "left").withColumn("_node", F.when(F.col("_several"), last).otherwise(F.col("_id")))
    gone = stage(duplicates(own.select(F.col("_node").alias("doc_id"), "text"), percent).where("NOT kept").select(F.col("doc_id").alias("_node")).distinct(), "gone")
    left = own.join(gone, "_node", "left_anti")
    if again:
        some = [f.name for f in left.schema.fields if f.name in inner and not isinstance(f.dataType, MapType | StructType | ArrayType | VariantType)]
        more = left.where("_several IS NOT NULL").groupBy("_id", "_h").agg(F.min_by(F.struct(*inner), F.xxhash64(*some)).alias("_row")).select("_row.*")
        left = left.where("_several IS NULL").select(*inner).unionAll(more.select(*inner))
    return left.select(*back)


#: A task compares two blocks of at most about so many sets, and so many shingles.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 20


def _across(buckets: DataFrame, led: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, for all pairs of sets in a bucket whose components differ.

    Buckets of one leader are a group. Its largest component need not be compared with itself, so its rows meet
    the blocks of the others only. Blocks are compared inside tasks, which put out no more than what joins components.
    """
    state = buckets.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = state.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    heads = led.join(mixed, "bucket", "left_semi").select("bucket", "head")
    rows = state.join(heads, "bucket").select("head", "node", "component").distinct()
    rows = stage(rows.join(sets.select("node", F.size("shingles").cast("long").alias("n")), "node"), "groups")
    parts = rows.groupBy("head", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    whole = parts.groupBy("head").agg(F.max_by("component", "rows").alias("main"), F.sum("rows").alias("all_rows"), F.sum("n").alias("all_n"))
    main = parts.select("head", F.col("component").alias("main"), F.col("rows").alias("main_rows"), F.col("n").alias("main_n"))
    many = lambda r, n: F.greatest(F.ceil(r / BLOCK_ROWS), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    plan = whole.join(main, ["head", "main"]).select("head", "main", many(F.col("main_rows"), F.col("main_n")).alias("main_blocks"), many(F.col("all_rows") - F.col("main_rows"), F.col("all_n") - F.col("main_n")).alias("blocks"))
    own = rows.join(stage(plan, "plan"), "head")
    is_main = F.col("component") == F.col("main")
    mine = F.when(is_main, F.col("blocks") + F.pmod(F.xxhash64("node"), F.col("main_blocks"))).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int")
    # blocks below `blocks` meet every block, the others only those
    meets = F.sequence(F.lit(0), F.when(is_main, F.col("blocks")).otherwise(F.col("blocks") + F.col("main_blocks")) - 1)
    dealt = own.select("head", "node", "component", mine.alias("mine"), F.explode(meets).alias("other"))
    dealt = dealt.select("head", "node", "component", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    dealt = dealt.join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        return _compare(table, percent)

    return dealt.groupBy("head", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of components that sets of block i and block j link."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    mine = table["mine"].to_numpy()
    comp = table["component"].to_numpy()
    lists = table["shingles"].combine_chunks()
    size = np.asarray(lists.value_lengths())
    row = np.repeat(np.arange(len(size)), size)
    _, column, count = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    common = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (first, first + width))
        some = np.zeros((len(size), width), np.float32)
        some[row[a:b], column[a:b] - first] = 1
        common += some[left] @ some[right].T
    both = size[left][:, None] + size[right][None, :] - common
    link = (100 * common >= percent * both) & (comp[left][:, None] != comp[right][None, :])
    x, y = np.nonzero(link)
    pairs = np.unique(np.sort(np.stack([comp[left[x]], comp[right[y]]], axis=1), axis=1), axis=0)
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    out = []
    for p, q in pairs.tolist():
        if top(p) != top(q):
            up[max(top(p), top(q))] = min(top(p), top(q))
            out.append((p, q))
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})


def _stored_sets(docs: DataFrame, reps: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, shingles) of the class representatives that share a bucket with others."""
    wanted = reps.select("doc_id", "fp1").join(buckets.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    wanted = stage(wanted, "wanted")
    texts = docs.join(wanted.select("doc_id"), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "doc_id long, fp1 long, shingles array<long>").join(wanted, ["doc_id", "fp1"], "left_semi")
    return stage(sets.dropDuplicates(["doc_id", "fp1"]).select(F.col("doc_id").alias("node"), "shingles"), "sets")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")
