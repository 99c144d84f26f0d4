"""Quality rules with a verdict on hosts, in DataFrame functions only.

Base rules judge a document by itself. The rate of failures of each host (`source`) is shrunk towards the
pooled rate by a beta prior whose strength is fitted to the spread between hosts (method of moments); documents
of a host whose shrunk rate is above `host_limit` are not kept.

Only narrow columns are moved: the base verdicts are written to the shared folder once, rates are partial sums
by host, and every host's rate is joined back to its documents, as it is part of the result. The table of rates is written, so
Spark knows its size: it is broadcast below Spark's own threshold, and beyond it the join is by host and salt, so that a hot
host's documents are dealt to SALTS tasks.

Defined cases: null text has no words, so it fails; a null host is judged by the base rules alone; without any
failure, or with failures everywhere, the prior is flat; repeated rows count each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.6
SALTS = 16
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def _repeats(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    A window is one long: the high bits of its hash, and its position in as many low bits as the text needs.
    Sorted, equal windows are neighbours; neighbours of equal hash bits are then compared word by word.
    """
    low = (F.lit(1).cast("long") * F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(2))))).cast("long")) - 1
    return F.struct(low.alias("low"), F.slice(F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(n - 2, F.lit(0))).alias("h"))


def base(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    step = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *keep,
        F.regexp_extract_all(text, F.lit(WORD), 0).alias("_w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    step = step.select("doc_id", *keep, "_w", F.size("_w").alias("_n"), F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"), "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    step = step.withColumn("_r", _repeats(F.col("_w"), F.col("_n")))
    packed = F.sort_array(F.transform("_r.h", lambda h, i: h.bitwiseAND(F.bitwise_not(F.col("_r.low"))).bitwiseOR(i.cast("long"))))
    step = step.withColumn("_s", packed)
    low, w, s = F.col("_r.low"), F.col("_w"), F.col("_s")

    def same(x: Column, y: Column) -> Column:
        p, q = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
        hashed = x.bitwiseXOR(y) <= low
        return (x.bitwiseXOR(y) >= 0) & hashed & (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))

    twice = F.filter("_s", lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)))
    step = step.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low))))
    p = F.col("_p")
    covered = F.aggregate(F.transform("_p", lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = step.select("doc_id", *keep, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def rules(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """A row per document (doc_id, text, host): the base figures, base_failed, host_rate, kept."""
    judged = stage(base(docs.select("doc_id", "text", F.col(host).cast("string").alias("_host")), "_host"), "base")
    hosts = judged.where("_host IS NOT NULL").groupBy("_host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("base_failed").cast("double")).alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    a, b = prior(total.n or 0.0, total.k or 0.0, total.kk or 0.0)
    rate = (F.col("k") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    rates = hosts.select("_host", F.round(rate, 9).alias("host_rate"), F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("_salt"))
    salted = judged.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(stage(rates, "rates"), ["_host", "_salt"], "left")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= host_limit)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", kept.alias("kept"))


def prior(n: float, k: float, kk: float) -> tuple[float, float]:
    """Alpha and beta from all rows, failures, and the sum over hosts of k^2 / n."""
    mean = k / n if n else 0.0
    spread = kk / n - mean * mean if n else 0.0
    if not 0 < mean < 1:
        return 1.0, 1.0
    strength = min(max(mean * (1 - mean) / spread - 1, 2.0), 1000.0) if spread > 0 else 1000.0
    return mean * strength, (1 - mean) * strength
