"""Rows of Python objects to columns and back.

Dataclasses and dictionaries are rows; the columns come in the order in which names are first seen. Bare integers
have no width, so they need a declared type; nested containers need an explicit schema.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import typing
from collections.abc import Iterable, Iterator
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidError, UnknownTypeError
from ..plans.types import infer

Row = TypeVar("Row")
_SPARK = {"bool": T.BooleanType(), "utf8": T.StringType(), "binary": T.BinaryType(), "float64": T.DoubleType(), "date64": T.TimestampType()}


def _fields(row: Any) -> dict[str, Any]:
    if dataclasses.is_dataclass(row):
        return {f.name: getattr(row, f.name) for f in dataclasses.fields(row)}
    if isinstance(row, dict):
        return row
    raise InvalidError(f"{type(row).__name__} is no row")


def _schema(rows: list[dict[str, Any]]) -> T.StructType:
    found: dict[str, T.DataType | None] = {}
    for row in rows:
        for name, value in row.items():
            found.setdefault(name, None)
            if value is not None and found[name] is None:
                found[name] = _SPARK[infer(value).kind]
    if missing := [k for k, v in found.items() if v is None]:
        raise UnknownTypeError(f"no value tells the type of {', '.join(missing)}")
    return T.StructType([T.StructField(k, v) for k, v in found.items()])


def schema_of(kind: type) -> T.StructType:
    """The schema of a dataclass by its annotations; Optional fields are nullable, an integer's width is given as Annotated[int, LongType()]."""
    out = []
    for f in dataclasses.fields(kind):
        hint = typing.get_type_hints(kind, include_extras=True)[f.name]
        args = typing.get_args(hint)
        nullable = type(None) in args
        if nullable:
            hint = next(a for a in args if a is not type(None))
        if typing.get_origin(hint) is typing.Annotated:
            declared = next((m for m in hint.__metadata__ if isinstance(m, T.DataType)), None)
        else:
            declared = {str: T.StringType(), bool: T.BooleanType(), float: T.DoubleType(), bytes: T.BinaryType(), dt.datetime: T.TimestampType(), dt.date: T.DateType()}.get(hint)
        if declared is None:
            raise UnknownTypeError(f"{f.name}: {hint} needs a declared type")
        out.append(T.StructField(f.name, declared, nullable))
    return T.StructType(out)


def encode(spark: SparkSession, rows: Iterable[Any], schema: T.StructType | None = None) -> DataFrame | None:
    """Rows as a DataFrame; None if there are none."""
    rows = [_fields(r) for r in rows]
    if not rows:
        return None
    schema = schema or _schema(rows)
    for f in schema:
        if not f.nullable and any(r.get(f.name) is None for r in rows):
            raise InvalidError(f"{f.name}: null where the schema allows none")
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def encode_values(spark: SparkSession, values: Iterable[Any], kind: T.DataType) -> DataFrame:
    """Single values as the column col0."""
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("col0", kind)]))


def encode_map(spark: SparkSession, mapping: dict[Any, Any], key: T.DataType, value: T.DataType) -> DataFrame:
    """A mapping as the columns col0 (keys) and col1 (values)."""
    return spark.createDataFrame(list(mapping.items()), T.StructType([T.StructField("col0", key, False), T.StructField("col1", value)]))


def explode_map(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A map column as rows (key, value)."""
    return df.select(*keep, F.explode(column).alias("key", "value"))


def decode(df: DataFrame, kind: type[Row]) -> Iterator[Row]:
    """Rows as dataclass objects, streamed. A missing column, or null where the class has no default of None, is an error."""
    hints = typing.get_type_hints(kind)
    fields = dataclasses.fields(kind)
    optional = {f.name for f in fields if type(None) in typing.get_args(hints[f.name])}
    place = {name: k for k, name in enumerate(df.columns)}  # of equal names the last
    if missing := [f.name for f in fields if f.name not in place]:
        raise InvalidError(f"no column {', '.join(missing)}")
    for row in df.toLocalIterator(prefetchPartitions=True):
        values = {f.name: row[place[f.name]] for f in fields}
        for name, value in values.items():
            if value is None and name not in optional:
                raise InvalidError(f"null in {name}, which is not optional")
        yield kind(**values)


def decode_rows(df: DataFrame) -> Iterator[tuple]:
    """Rows by position, streamed."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield tuple(row)


def decode_column(df: DataFrame, column: str | None = None, optional: bool = False) -> Iterator[Any]:
    """One column's values, streamed."""
    for (value,) in df.select(column or df.columns[0]).toLocalIterator(prefetchPartitions=True):
        if value is None and not optional:
            raise InvalidError("null in a column that is not optional")
        yield value


def decode_map(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(key, value) of a table of exactly two columns; of equal keys the last row in the order wins."""
    if len(df.columns) - len(order or ()) != 2:
        raise InvalidError("a mapping has exactly two columns")
    key, value = [c for c in df.columns if c not in (order or ())]
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)) if order else F.last(F.struct(F.col(value).alias("v")))
    return df.groupBy(F.col(key).alias("key")).agg(last.alias("_l")).select("key", F.col("_l.v").alias("value"))
