"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for the rest.

URLs that a rule decides are the labelled ones. Suffix statistics (block rates of a host's last label and last
two labels, over all labelled URLs) are partial sums by suffix and fold. A URL that is fitted has the rates of the other
folds, so its own label does not reach its features; all others have those of all folds. The trees are fitted on the driver to about
TRAIN_ROWS labelled URLs, an even share by hash; this bound and the trees' size are parameters.

Features: length of url, host and path; depth; share of digits; entropy of bytes; parameters; hyphens; labels of
the host; block rates of the two suffixes.

Defined cases: a null url, or one without ://, has an empty host and path and is judged by the method; without
labelled urls the method allows all; a suffix never seen has the pooled rate; of rules that fit equally long
the one with the longer host wins; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stage
from ._text import text_bytes

TRAIN_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 32
RATE = 0.2
SMOOTH = 20.0
FOLDS = 5
#: Rows whose features are worked out together.
ROWS = 4096


@dataclass
class Trees:
    """Boosted trees of equal depth: split features and thresholds by level order, and leaf values."""

    base: float = 0.0
    depth: int = DEPTH
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Logistic loss, second-order leaf values, splits on quantile bins."""
    share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), depth)
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                best = 1e-6
                for j, e in enumerate(edges):
                    if not len(own) or not len(e):
                        continue
                    gs = np.cumsum(np.bincount(code[own, j], g[own], len(e) + 1))
                    hs = np.cumsum(np.bincount(code[own, j], h[own], len(e) + 1))
                    gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    i = int(np.argmax(gain))
                    if gain[i] > best:
                        best, f[k], c[k] = gain[i], j, e[i]
                node[own] = 2 * k + 1 + (x[own, f[k]] > c[k])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        margin += value[leaf]
        model.features.append(f)
        model.cuts.append(c)
        model.leaves.append(value)
    return model


def lexical(url: pa.Array, host: pa.Array, path: pa.Array, rates: list[np.ndarray]) -> np.ndarray:
    """An (n, 11) array of the features."""
    url, host, path = (pc.fill_null(x.cast(pa.large_string()), "") for x in (url, host, path))
    data, at = text_bytes(url)
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    share = np.bincount(owner * 256 + data, minlength=256 * len(size)).reshape(-1, 256) / np.maximum(size, 1)[:, None]
    entropy = np.round(-(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1), 9)  # so that equal ones do not hang on the order of bytes
    digits = np.bincount(owner, (data >= 48) & (data <= 57), len(size)) / np.maximum(size, 1)
    query = pc.replace_substring_regex(pc.replace_substring_regex(url, r"(?s)^[^?]*\??", ""), r"(?s)#.*$", "")
    count = lambda x, of: np.asarray(pc.count_substring(x, of))
    filled = np.asarray(pc.binary_length(host)) > 0
    length = [np.asarray(pc.utf8_length(x)) for x in (host, path)]
    return np.stack([size, *length, count(path, "/"), digits, entropy, np.asarray(pc.count_substring_regex(query, "[^&]+")), count(host, "-"), count(host, ".") + filled, *rates], axis=1).astype(np.float64)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    lower = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, of rules (verdict, host/path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(set(rules), key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), r)):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def judge(pages: DataFrame, rules: list[tuple[str, str]], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score (the trees' probability of block; null where a rule decides)."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"), _suffix(F.col("host"), 1).alias("s1"), _suffix(F.col("host"), 2).alias("s2"))
    rows = rows.withColumn("fold", F.when(F.col("ruled").isNotNull(), F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS))))
    known = rows.where("ruled IS NOT NULL").withColumn("y", (F.col("ruled") == "block").cast("double"))
    pooled = known.agg(F.count("*").alias("n"), F.sum("y").alias("k")).first()
    mean = (pooled.k + 0.5) / (pooled.n + 1.0) if pooled.n else 0.0
    for s in ("s1", "s2"):
        own = lambda f, v: F.sum(F.when(F.col("fold") == f, v).otherwise(0.0))
        sums = known.groupBy(s).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("k"), F.array(*(own(f, 1.0) for f in range(FOLDS))).alias("ns"), F.array(*(own(f, F.col("y")) for f in range(FOLDS))).alias("ks"))
        less = lambda c: F.col(c) - F.coalesce(F.get(F.col(f"{c}s"), F.col("fold")), F.lit(0.0))
        rows = rows.join(stage(sums, f"rate-{s}"), s, "left").withColumn(f"{s}_rate", F.coalesce((less("k") + SMOOTH * mean) / (less("n") + SMOOTH), F.lit(mean))).drop("n", "k", "ns", "ks")
    rows = rows.select("page_id", "url", "host", "path", "rule", "ruled", "s1_rate", "s2_rate")
    # an even share of the labelled urls by hash, so that no more than about the sample comes to the driver
    share = min(1.0, train_rows / max(1, pooled.n))
    sample = rows.where(F.col("ruled").isNotNull() & (F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 30)) < round(share * (1 << 30))))
    sample = sample.toArrow().sort_by([("url", "ascending"), ("page_id", "ascending")]).combine_chunks()
    column = lambda t, c: t.column(c).combine_chunks() if isinstance(t, pa.Table) else t.column(c)

    def features(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        return lexical(column(t, "url"), column(t, "host"), column(t, "path"), [column(t, c).to_numpy(zero_copy_only=False) for c in ("s1_rate", "s2_rate")])

    x = np.concatenate([features(sample.slice(k, ROWS)) for k in range(0, sample.num_rows, ROWS)]) if sample.num_rows else np.zeros((0, 11))
    trees = fit_trees(x, np.asarray(pc.equal(column(sample, "ruled"), "block"), np.float64))
    held = pages.sparkSession.sparkContext.broadcast(trees if sample.num_rows else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ruled = part.column("ruled")
                score = pa.array(np.zeros(part.num_rows) if model is None else 1 / (1 + np.exp(-model.margin(features(part)))))
                verdict = pc.coalesce(ruled, pc.if_else(pc.greater(score, 0.5), "block", "allow"))
                own = pc.if_else(pc.is_valid(ruled), pa.scalar(None, pa.float64()), score)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host", "path", "rule")), verdict.cast(pa.string()), own], ["page_id", "url", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(run, "page_id long, url string, host string, path string, rule string, verdict string, score double")
