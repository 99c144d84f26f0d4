"""Schemas: ordered fields with metadata. Names may repeat; a name then means the last field that has it."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidError, OutOfBoundsError
from . import types as types_
from .types import Field


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    metadata: dict[str, str] = field(default_factory=dict, compare=False)

    @classmethod
    def from_arrow(cls, schema: pa.Schema) -> Schema:
        return cls(tuple(types_.field_from_arrow(f) for f in schema), {k.decode(): v.decode() for k, v in (schema.metadata or {}).items()})

    def field(self, index: int) -> Field:
        if not 0 <= index < len(self.fields):
            raise OutOfBoundsError(f"no field {index} of {len(self.fields)}")
        return self.fields[index]

    def index(self, name: str) -> int | None:
        found = [k for k, f in enumerate(self.fields) if f.name == name]
        return found[-1] if found else None

    def contains(self, other: Schema) -> bool:
        """Whether data of the other schema fits this one, field by field."""
        return len(self.fields) == len(other.fields) and all(a.contains(b) for a, b in zip(self.fields, other.fields, strict=True))


class SchemaBuilder:
    """Fields one after another."""

    def __init__(self) -> None:
        self._fields: list[Field] = []

    def add(self, name: str, type_: types_.Type, nullable: bool = True, metadata: dict[str, str] | None = None) -> SchemaBuilder:
        self._fields.append(Field(name, type_, nullable).with_metadata(metadata or {}))
        return self

    def finish(self) -> Schema:
        return Schema(tuple(self._fields))


def to_spark(schema: pa.Schema) -> T.StructType:
    return T.StructType([types_.spark_field(f) for f in schema])


def last_index(df: DataFrame, name: str) -> int | None:
    """Place of the last column of that name."""
    found = [k for k, c in enumerate(df.columns) if c == name]
    return found[-1] if found else None


def violations(df: DataFrame, not_null: list[str]) -> DataFrame:
    """(column, nulls) of the columns that must not be null and are; one pass over those columns."""
    if not not_null:
        return df.sparkSession.createDataFrame([], "column string, nulls long")
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in not_null))
    return counts.unpivot([], not_null, "column", "nulls").where("nulls > 0").select(F.col("column"), F.col("nulls").cast("long").alias("nulls"))


def require(df: DataFrame, not_null: list[str]) -> DataFrame:
    """df whose rows raise an error where a column that must not be null is; checked as the rows pass by."""
    for c in not_null:
        df = df.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.lit(f"{c}: null where none is allowed")).cast(df.schema[c].dataType)))
    return df


def require_same(frames: list[DataFrame]) -> None:
    """All frames have the first one's types, column by column; no coercion."""
    first = [f.dataType for f in frames[0].schema]
    for df in frames[1:]:
        if [f.dataType for f in df.schema] != first:
            raise InvalidError(f"batches differ: {frames[0].schema.simpleString()} and {df.schema.simpleString()}")
