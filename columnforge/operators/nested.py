"""Lists, structs and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_values(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """The kept columns, and a row (pos, value) for each element; null and empty lists have none."""
    return df.select(*keep, F.posexplode(column).alias("pos", "value"))


def child_slice(column: str, start: int, length: int) -> Column:
    """Elements from `start` (counted from 0) on, as many as there are up to `length`."""
    return F.slice(F.col(column), start + 1, length)


def element(column: str, index: int) -> Column:
    """The element at a place from 0; null beyond the ends."""
    return F.get(F.col(column), F.lit(index))


def fixed_size(column: str, size: int) -> Column:
    """Whether a list has the fixed size; null stays null."""
    return F.size(F.col(column)) == size if size >= 0 else F.lit(None).cast("boolean")


def fixed_bytes(column: Column, width: int, index: int) -> Column:
    """Value `index` of bytes that hold values of `width` bytes each."""
    return F.substring(column, index * width + 1, width)


def require_width(column: Column, width: int) -> Column:
    """The bytes, or an error if their number is not `width`."""
    return F.when(column.isNull() | (F.octet_length(column) == width), column).otherwise(F.raise_error(F.lit(f"not {width} bytes wide")).cast("binary"))


def build_lists(df: DataFrame, keys: list[str], value: str, order: str, name: str = "values") -> DataFrame:
    """A list of the values of each key, in the order of a column. A list is one value, so one task holds it."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def build_struct(fields: dict[str, Column], valid: Column | None = None) -> Column:
    """A struct, null where it is not valid; then its fields read as null too."""
    made = F.struct(*(v.alias(k) for k, v in fields.items()))
    return made if valid is None else F.when(valid, made)


def struct_map(column: str, fields: list[str]) -> Column:
    """A struct as a map from field names to text."""
    return F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f"{column}.{f}").cast("string"))))
