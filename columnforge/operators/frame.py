"""Row positions, slices, null counts, projection, concatenation and chunks.

A DataFrame has no row order, so whatever depends on positions takes the columns of a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidError, NoElementsError, OutOfBoundsError
from ..plans.schema import last_index, require_same
from ..sources.shared import stage

#: A slice that ends before this row is a top-k; one beyond it finds the same rows by their global index.
TOP_ROWS = 100_000


def _place(df: DataFrame, name: str) -> int:
    k = last_index(df, name)
    if k is None:
        raise InvalidError(f"no column {name!r}")
    return k


def _ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    """df under inner names, sorted over range partitions, with the partition and the row's number in it; and those names.

    It is written once: ranges are drawn from a sample, so a second run of the same plan may part the rows elsewhere.
    """
    inner = [f"_{k}" for k in range(len(df.columns))]
    keys = [inner[_place(df, c)] for c in order]
    rows = df.toDF(*inner).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    return stage(rows.select(*inner, F.shiftright(at, 33).cast("int").alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")), "ranked"), inner


def _before(parts: DataFrame, amount: str) -> DataFrame:
    """(_part, _before): what the partitions before each hold; a row for each partition."""
    # one short row for each partition, whatever the data
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select("_part", F.sum(amount).over(w).alias("_before")))


def _named(df: DataFrame, rows: DataFrame, inner: list[str], more: Column, name: str) -> DataFrame:
    return rows.select(*(F.col(a).alias(b) for a, b in zip(inner, df.columns, strict=True)), more.alias(name))


def with_index(df: DataFrame, order: list[str]) -> DataFrame:
    """df with row_index, the row's place from 0 in the order, without gathering rows in one task.

    Rows are dealt out by ranges and written; a partition's first index is the number of rows in the ones before it.
    """
    rows, inner = _ranked(df, order)
    starts = _before(rows.groupBy("_part").agg(F.count("*").alias("n")), "n")
    return _named(df, rows.join(starts, "_part", "left"), inner, F.coalesce("_before", F.lit(0).cast("long")) + F.col("_at"), "row_index")


def prefix_sums(df: DataFrame, amount: str, order: list[str]) -> DataFrame:
    """df with running, the sum of `amount` up to and including each row in the order; null until there is an amount."""
    rows, inner = _ranked(df, order)
    own = inner[_place(df, amount)]
    starts = _before(rows.groupBy("_part").agg(F.sum(own).alias("n")), "n")
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(own).over(w)).join(starts, "_part", "left")
    running = F.when(F.col("_sum").isNull(), F.col("_before")).when(F.col("_before").isNull(), F.col("_sum")).otherwise(F.col("_before") + F.col("_sum"))
    return _named(df, rows, inner, running, "running")


def slice_rows(df: DataFrame, order: list[str], offset: int, length: int, top_rows: int = TOP_ROWS) -> DataFrame:
    """`length` rows from `offset` on; a slice of a slice counts from the slice's own start."""
    if offset < 0 or length < 0:
        raise OutOfBoundsError("offset and length are not negative")
    if offset + length <= top_rows:
        return df.orderBy(*order).offset(offset).limit(length)
    rows, inner = _ranked(df, order)
    starts = _before(rows.groupBy("_part").agg(F.count("*").alias("n")), "n")
    at = F.coalesce("_before", F.lit(0).cast("long")) + F.col("_at")
    return rows.join(starts, "_part", "left").where((at >= offset) & (at < offset + length)).select(*inner).toDF(*df.columns)


def nth_row(df: DataFrame, order: list[str], index: int) -> DataFrame:
    """The row at a position; none beyond the end."""
    return slice_rows(df, order, index, 1)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, rows, nulls), all columns in one pass."""
    columns = columns or df.columns
    counts = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    return counts.unpivot(["n"], columns, "column", "valid").select("column", F.col("n").alias("rows"), (F.col("n") - F.col("valid")).alias("nulls"))


def null_mask(*columns: str) -> list[Column]:
    return [F.col(c).isNull().alias(f"{c}_is_null") for c in columns]


def column_by_name(df: DataFrame, name: str) -> DataFrame | None:
    """The last column of that name, alone; None if there is none."""
    k = last_index(df, name)
    return None if k is None else columns_by_index(df, [k])


def columns_by_index(df: DataFrame, indexes: list[int]) -> DataFrame:
    """Columns by place, so names may repeat."""
    for k in indexes:
        if not 0 <= k < len(df.columns):
            raise OutOfBoundsError(f"no column {k} of {len(df.columns)}")
    unique = [f"_{k}" for k in range(len(df.columns))]
    picked = df.toDF(*unique).select(*(unique[k] for k in indexes))
    return picked.toDF(*(df.columns[k] for k in indexes))


def typed_column(df: DataFrame, name: str, kind: T.DataType) -> DataFrame:
    """The column, if it has exactly that type; nothing is coerced."""
    k = last_index(df, name)
    if k is None:
        raise InvalidError(f"no column {name!r}")
    if df.schema[k].dataType != kind:
        raise InvalidError(f"{name!r} is {df.schema[k].dataType.simpleString()}, not {kind.simpleString()}")
    return columns_by_index(df, [k])


def concat(batches: list[DataFrame]) -> DataFrame:
    """One table of all batches' rows under the first one's names; types must be the same."""
    if not batches:
        raise NoElementsError("a table needs at least one batch")
    require_same(batches)
    return reduce(DataFrame.unionAll, batches)


def chunk_stats(chunks: list[DataFrame], column: str) -> DataFrame:
    """(chunk, length, nulls) of each chunk of a chunked column."""
    if not chunks:
        raise NoElementsError("a chunked column needs at least one chunk")
    require_same([c.select(column) for c in chunks])
    rows = reduce(DataFrame.unionAll, [c.select(F.lit(k).alias("chunk"), F.col(column).alias("_v")) for k, c in enumerate(chunks)])
    return rows.groupBy("chunk").agg(F.count("*").alias("length"), F.count_if(F.col("_v").isNull()).alias("nulls"))


def batch_lengths(columns: dict[str, DataFrame]) -> DataFrame:
    """(column, length) of columns that are to form a batch."""
    if not columns:
        raise InvalidError("a batch has at least one column")
    return reduce(DataFrame.unionAll, [df.agg(F.count("*").alias("length")).select(F.lit(name).alias("column"), "length") for name, df in columns.items()])


def assemble(columns: dict[str, list], schema: T.StructType, spark) -> DataFrame:
    """A small batch from columns of equal length in memory; nullability is checked. Columns of tables go through zip_columns."""
    if not columns:
        raise InvalidError("a batch has at least one column")
    if len(sizes := {len(v) for v in columns.values()}) > 1:
        raise InvalidError(f"columns of unequal length: {', '.join(map(str, sorted(sizes)))}")
    for f, values in zip(schema, columns.values(), strict=True):
        if not f.nullable and (nulls := sum(v is None for v in values)):
            raise InvalidError(f"column {f.name!r} must not be null, but {nulls} of its values are")
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


def zip_columns(columns: dict[str, tuple[DataFrame, str, list[str]]], not_null: tuple[str, ...] = ()) -> DataFrame:
    """A table from columns of several tables, each (table, column, order): row k has each one's k-th value, and row_index k.

    Lengths are compared first and nulls of the columns `not_null` counted, as summing up is cheaper than joining; then
    the columns meet by their positions, so no rows are gathered.
    """
    lengths = batch_lengths({name: df for name, (df, _, _) in columns.items()}).collect()  # a row for each column
    if len({r.length for r in lengths}) > 1:
        raise InvalidError(f"columns of unequal length: {', '.join(f'{r.column} {r.length}' for r in lengths)}")
    for name in not_null:
        df, column, _ = columns[name]
        if nulls := df.where(F.col(column).isNull()).count():
            raise InvalidError(f"column {name!r} must not be null, but {nulls} of its values are")
    parts = []
    for name, (df, column, order) in columns.items():
        own = df.select(*(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.col(column).alias("_v"))
        parts.append(with_index(own, [f"_o{k}" for k in range(len(order))]).select("row_index", F.col("_v").alias(name)))
    return reduce(lambda a, b: a.join(b, "row_index"), parts)


def any_values(df: DataFrame, order: list[str], index: int) -> DataFrame:
    """(column, type, value as text) of the row at a position, whatever the columns' types; null is null."""
    row = nth_row(df, order, index)
    made = F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in df.schema))
    return row.select(F.inline(made))
