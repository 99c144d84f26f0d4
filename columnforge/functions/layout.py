"""The buffers that a column would have in the columnar format, as relations derived from its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frame import prefix_sums, with_index


def validity_bytes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bytes): none where no value or every value is null, else a bit a row."""
    counts = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    out = counts.unpivot(["n"], columns, "column", "valid")
    size = F.when((F.col("valid") == F.col("n")) | (F.col("valid") == 0), F.lit(0)).otherwise(F.ceil(F.col("n") / 8))
    return out.select("column", size.cast("long").alias("bytes"))


def validity_bits(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(byte, bits): the validity bitmap in the given order, eight rows a byte, the first row in the lowest bit."""
    rows = with_index(df.select(*order, F.col(column).isNotNull().cast("int").alias("_valid")), order)
    index = F.col("row_index")
    return rows.groupBy(F.call_function("div", index, F.lit(8).cast("long")).alias("byte")).agg(F.sum(F.call_function("shiftleft", F.col("_valid"), F.pmod(index, F.lit(8)).cast("int"))).cast("long").alias("bits"))


def offsets(df: DataFrame, size: Column, order: list[str], *keep: str) -> DataFrame:
    """The kept columns, and each value's begin and end in the data buffer; null takes no bytes."""
    return prefix_sums(df.select(*dict.fromkeys([*order, *keep]), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("_size")), "_size", order).select(*keep, (F.col("running") - F.col("_size")).alias("begin"), F.col("running").alias("end"))


def buffer_sizes(df: DataFrame, fixed: dict[str, int], variable: list[str]) -> DataFrame:
    """(column, rows, values, offsets): bytes of the value buffer, and of 32-bit offsets where values vary in length."""
    sums = df.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long").alias(c) for c in variable))
    sums = sums.select("n", *(c for c in variable), *((F.col("n") * w).cast("long").alias(c) for c, w in fixed.items()))
    out = sums.unpivot(["n"], [*variable, *fixed], "column", "values")
    return out.select("column", F.col("n").alias("rows"), "values", F.when(F.col("column").isin(variable), 4 * (F.col("n") + 1)).otherwise(F.lit(0)).cast("long").alias("offsets"))
