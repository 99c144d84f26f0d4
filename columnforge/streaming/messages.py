"""Record batches and schemas as messages of header and body, in memory or in a byte stream."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import SourceError
from ..plans.schema import to_spark
from ..plans.types import legalise


#: Bytes in one stream of a partition; a binary value has 2 GB at most.
PIECE_BYTES = 32 << 20


def encode_schema(schema: pa.Schema) -> bytes:
    return schema.serialize().to_pybytes()


def decode_schema(data: bytes) -> pa.Schema:
    try:
        return pa.ipc.read_schema(pa.py_buffer(data))
    except pa.ArrowInvalid as e:
        raise SourceError(f"no schema message: {e}") from e


def encode_batch(batch: pa.RecordBatch) -> tuple[bytes, bytes]:
    """Header and body of a batch's message."""
    message = pa.ipc.read_message(batch.serialize())
    return message.metadata.to_pybytes(), message.body.to_pybytes() if message.body else b""


@dataclass
class Result:
    """What messages have brought so far: a schema, then batches."""

    schema: pa.Schema | None = None
    batches: list[pa.RecordBatch] = field(default_factory=list)

    def take(self, data: bytes) -> None:
        """One encapsulated message more."""
        message = pa.ipc.read_message(pa.py_buffer(data))
        if message.type == "schema":
            self.schema = pa.ipc.read_schema(message)
        elif message.type == "record batch":
            if self.schema is None:
                raise SourceError("a batch came before the schema")
            self.batches.append(pa.ipc.read_record_batch(message, self.schema))
        else:
            raise SourceError(f"a message of kind {message.type!r} is not expected")


def to_stream(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> bytes:
    """The schema once, every batch, an end mark."""
    out = io.BytesIO()
    with pa.ipc.new_stream(out, schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return out.getvalue()


def from_stream(data: bytes) -> Iterator[pa.RecordBatch]:
    try:
        yield from pa.ipc.open_stream(pa.py_buffer(data))
    except pa.ArrowInvalid as e:
        raise SourceError(f"no stream of batches: {e}") from e


def to_file_bytes(df: DataFrame) -> bytes:
    """A whole file in memory; for results that the driver can hold."""
    table = df.toArrow()
    out = io.BytesIO()
    with pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def from_file_bytes(spark, data: bytes) -> DataFrame:
    """The rows of a file in memory."""
    return from_table(spark, pa.ipc.open_file(pa.py_buffer(data)).read_all())


def from_table(spark, table: pa.Table) -> DataFrame:
    """A table as a DataFrame, Spark-legal, with field metadata."""
    schema: T.StructType = to_spark(table.schema)
    legal = pa.Table.from_arrays([legalise(c) for c in table.columns], table.schema.names)
    return spark.createDataFrame(legal, schema)


def partition_streams(df: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(partition, piece, stream): each partition's rows as streams of messages of about `piece_bytes` at most, encoded where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[pa.RecordBatch] = []
        size = piece = 0

        def out() -> pa.RecordBatch:
            data = to_stream(held, held[0].schema)
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([piece], pa.int32()), pa.array([data], pa.binary())], ["partition", "piece", "stream"])

        for batch in batches:
            if held and size + batch.nbytes > piece_bytes:
                yield out()
                held, size, piece = [], 0, piece + 1
            held.append(batch)
            size += batch.nbytes
        if held:
            yield out()

    return df.mapInArrow(run, "partition int, piece int, stream binary")


def read_streams(streams: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of a column `stream` of message streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("stream").to_pylist():
                yield from from_stream(data)

    return streams.select("stream").mapInArrow(run, schema)
