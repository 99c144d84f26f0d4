"""Batches over remote procedure calls: a server on the driver, a client, and a data source over endpoints.

The registry maps flight names to DataFrames. A ticket names a flight, or one partition of it, so that several
readers can each fetch a part. Batches leave the driver partition by partition; a put of any number of batches has
its schema once.

A server answers with jobs of its own session. A reader of the same session must leave it task slots: with as many
endpoints as slots each would wait for the other.
"""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.flight as fl
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import InvalidError, NoElementsError, UnsupportedError
from ..plans.schema import to_spark
from ..plans.types import legalise
from ..streaming.messages import encode_schema
from .ipc import open_store
from .ipc import register as register_files
from .shared import new_path


@dataclass(frozen=True)
class Descriptor:
    """A flight's path, or a command."""

    path: tuple[str, ...] = ()
    command: bytes = b""

    @property
    def name(self) -> str:
        return self.command.decode() if self.command else "/".join(self.path)

    def to_flight(self) -> fl.FlightDescriptor:
        return fl.FlightDescriptor.for_command(self.command) if self.command else fl.FlightDescriptor.for_path(*self.path)

    @classmethod
    def of(cls, d: fl.FlightDescriptor) -> Descriptor:
        return cls(command=d.command) if d.command else cls(tuple(p.decode() for p in d.path or ()))


@dataclass(frozen=True)
class Ticket:
    """A flight, or one of its partitions."""

    name: str
    partition: int | None = None

    def encode(self) -> bytes:
        return json.dumps([self.name, self.partition]).encode()

    @classmethod
    def decode(cls, data: bytes) -> Ticket:
        try:
            return cls(*json.loads(data))
        except (ValueError, TypeError) as e:
            raise InvalidError(f"no ticket: {data[:40]!r}") from e


@dataclass(frozen=True)
class Info:
    schema: pa.Schema
    descriptor: Descriptor
    tickets: tuple[Ticket, ...]
    locations: tuple[str, ...] = ()


@dataclass
class Registry:
    """Flights by name, actions, and how batches of an exchange are answered."""

    spark: SparkSession
    flights: dict[str, DataFrame] = field(default_factory=dict)
    actions: dict[str, tuple[str, Callable[[bytes], Iterable[bytes]]]] = field(default_factory=dict)
    exchange: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch
    commands: Callable[[str], DataFrame] | None = None

    def __post_init__(self) -> None:
        self._lock = threading.Lock()

    def put(self, name: str, df: DataFrame) -> None:
        with self._lock:
            self.flights[name] = df

    def get(self, name: str) -> DataFrame:
        df = self.flights.get(name)
        if df is None and self.commands:
            df = self.commands(name)
        if df is None:
            raise InvalidError(f"no flight {name!r}")
        return df

    def list(self, like: str = "") -> dict[str, DataFrame]:
        """Flights whose name fits a pattern of % and _; without one, all."""
        test = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in like) or ".*", re.DOTALL)
        return {n: df for n, df in sorted(self.flights.items()) if test.fullmatch(n)}

    def relation(self) -> DataFrame:
        """(name, columns) of the flights."""
        return self.spark.createDataFrame([(n, df.schema.simpleString()) for n, df in self.list().items()], "name string, columns string")


def arrow_schema(df: DataFrame) -> pa.Schema:
    return to_arrow_schema(df.schema)


def encoded(df: DataFrame) -> RDD:
    """The batches of each partition, as streams of messages of one batch."""

    def encode(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["stream"])

    return df.mapInArrow(encode, "stream binary").rdd


def batches_of(df: DataFrame, partition: int | None = None, streams: RDD | None = None) -> Iterator[pa.RecordBatch]:
    """Batches as they leave the executors, one partition after another; or those of one partition, running no other."""
    schema, streams = arrow_schema(df), streams or encoded(df)
    rows = streams.toLocalIterator(prefetchPartitions=True) if partition is None else streams.context.runJob(streams, lambda rows: list(rows), [partition])
    for row in rows:
        for batch in pa.ipc.open_stream(row.stream):
            yield batch.cast(schema)


class Server(fl.FlightServerBase):
    """Answers all calls from a registry."""

    def __init__(self, registry: Registry, location: str = "grpc://127.0.0.1:0") -> None:
        super().__init__(location)
        self.registry = registry
        self._streams: dict[str, tuple[DataFrame, RDD]] = {}

    def _encoded(self, name: str, df: DataFrame) -> RDD:
        """A flight's streams, planned once, so that its partitions stay what its tickets say."""
        if name not in self.registry.flights:
            return encoded(df)
        if self._streams.get(name, (None, None))[0] is not df:
            self._streams[name] = df, encoded(df)
        return self._streams[name][1]

    def list_actions(self, context):
        return [(kind, text) for kind, (text, _) in sorted(self.registry.actions.items())]

    def do_action(self, context, action):
        if action.type not in self.registry.actions:
            raise NotImplementedError(f"no action {action.type!r}")
        for data in self.registry.actions[action.type][1](action.body.to_pybytes()):
            yield fl.Result(data)

    def _info(self, descriptor: fl.FlightDescriptor, name: str, df: DataFrame) -> fl.FlightInfo:
        parts = max(1, self._encoded(name, df).getNumPartitions()) if name in self.registry.flights else 1
        tickets = [Ticket(name, k if parts > 1 else None) for k in range(parts)]
        return fl.FlightInfo(arrow_schema(df), descriptor, [fl.FlightEndpoint(t.encode(), [f"grpc://127.0.0.1:{self.port}"]) for t in tickets], -1, -1)

    def list_flights(self, context, criteria):
        for name, df in self.registry.list((criteria or b"").decode()).items():
            yield self._info(fl.FlightDescriptor.for_path(name), name, df)

    def get_flight_info(self, context, descriptor):
        name = Descriptor.of(descriptor).name
        return self._info(descriptor, name, self.registry.get(name))

    def get_schema(self, context, descriptor):
        return fl.SchemaResult(arrow_schema(self.registry.get(Descriptor.of(descriptor).name)))

    def do_get(self, context, ticket):
        wanted = Ticket.decode(ticket.ticket)
        df = self.registry.get(wanted.name)
        return fl.GeneratorStream(arrow_schema(df), batches_of(df, wanted.partition, self._encoded(wanted.name, df)))

    def do_put(self, context, descriptor, reader, writer):
        spark, rows = self.registry.spark, 0
        path = new_path(spark, "put")
        store, inner = open_store(path)
        store.create_dir(inner, recursive=True)
        # written as they come, so that no more than a batch is held here
        with store.open_output_stream(f"{inner}/put.arrows") as sink, pa.ipc.new_stream(sink, reader.schema) as out:
            for chunk in reader:
                if chunk.data is not None:
                    out.write_batch(chunk.data)
                    rows += chunk.data.num_rows
                    writer.write(str(rows).encode())
        register_files(spark)
        self.registry.put(Descriptor.of(descriptor).name, spark.read.format("colstream").load(path))
        writer.write(str(rows).encode())

    def do_exchange(self, context, descriptor, reader, writer):
        begun = False
        for chunk in reader:
            if chunk.data is None:
                continue
            answer = self.registry.exchange(chunk.data)
            if not begun:
                writer.begin(answer.schema)
                begun = True
            writer.write_batch(answer)
        if not begun:
            writer.begin(reader.schema)


class Client:
    """The calls; handshakes and polling are not offered."""

    def __init__(self, location: str) -> None:
        self.location, self.inner = location, fl.connect(location)

    def list_actions(self) -> list[tuple[str, str]]:
        return [(a.type, a.description) for a in self.inner.list_actions()]

    def do_action(self, kind: str, body: bytes = b"") -> list[bytes]:
        return [r.body.to_pybytes() for r in self.inner.do_action(fl.Action(kind, body))]

    def list_flights(self, like: str = "") -> list[Info]:
        return [self._info(i) for i in self.inner.list_flights(like.encode())]

    def get_info(self, descriptor: Descriptor) -> Info:
        return self._info(self.inner.get_flight_info(descriptor.to_flight()))

    @staticmethod
    def _info(i: fl.FlightInfo) -> Info:
        return Info(i.schema, Descriptor.of(i.descriptor), tuple(Ticket.decode(e.ticket.ticket) for e in i.endpoints), tuple(x.uri.decode() for e in i.endpoints for x in e.locations))

    def get_schema(self, descriptor: Descriptor) -> pa.Schema:
        return self.inner.get_schema(descriptor.to_flight()).schema

    def do_get(self, ticket: Ticket) -> Iterator[pa.RecordBatch]:
        for chunk in self.inner.do_get(fl.Ticket(ticket.encode())):
            yield chunk.data

    def do_get_messages(self, ticket: Ticket) -> Iterator[tuple[bytes, bytes | None]]:
        """Raw messages: the schema's, then one for each batch, with its application metadata."""
        reader = self.inner.do_get(fl.Ticket(ticket.encode()))
        yield encode_schema(reader.schema), None
        for chunk in reader:
            yield chunk.data.serialize().to_pybytes(), chunk.app_metadata.to_pybytes() if chunk.app_metadata else None

    def do_put(self, descriptor: Descriptor, batches: list[pa.RecordBatch], on_result: Callable[[bytes], None] | None = None) -> int:
        """Send batches; the callback gets each acknowledgement, the last one at least. Returns the rows stored."""
        if not batches:
            raise NoElementsError("a put needs at least one batch")
        writer, reader = self.inner.do_put(descriptor.to_flight(), batches[0].schema)
        with writer:
            for batch in batches:
                writer.write_batch(batch)
            writer.done_writing()
            last = b"0"
            while (answer := reader.read()) is not None:
                last = answer.to_pybytes()
                if on_result:
                    on_result(last)
        return int(last)

    def do_exchange(self, descriptor: Descriptor, batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        if not batches:
            raise NoElementsError("an exchange needs at least one batch")
        writer, reader = self.inner.do_exchange(descriptor.to_flight())
        out: list[pa.RecordBatch] = []
        read = threading.Thread(target=lambda: out.extend(c.data for c in reader))
        with writer:
            writer.begin(batches[0].schema)
            read.start()  # read along, so that neither side waits for the other's buffer
            for batch in batches:
                writer.write_batch(batch)
            writer.done_writing()
            read.join()
        return out

    def handshake(self) -> None:
        raise UnsupportedError("handshake")

    def poll_info(self) -> None:
        raise UnsupportedError("poll_info")

    def close(self) -> None:
        self.inner.close()


@dataclass
class Endpoint(InputPartition):
    location: str
    ticket: bytes


class FlightReader(DataSourceReader):
    def __init__(self, location: str, flight: str) -> None:
        self.location, self.flight = location, flight

    def partitions(self) -> list[Endpoint]:
        info = fl.connect(self.location).get_flight_info(fl.FlightDescriptor.for_path(*self.flight.split("/")))
        return [Endpoint(e.locations[0].uri.decode() if e.locations else self.location, e.ticket.ticket) for e in info.endpoints]

    def read(self, partition: Endpoint) -> Iterator[pa.RecordBatch]:
        client = fl.connect(partition.location)
        try:
            for chunk in client.do_get(fl.Ticket(partition.ticket)):
                yield pa.RecordBatch.from_arrays([legalise(c) for c in chunk.data.columns], chunk.data.schema.names)
        finally:
            client.close()


class FlightSource(DataSource):
    """Format "colflight": a partition for each endpoint of a flight. Options: location, flight."""

    @classmethod
    def name(cls) -> str:
        return "colflight"

    def schema(self) -> T.StructType:
        d = fl.FlightDescriptor.for_path(*self.options["flight"].split("/"))
        return to_spark(fl.connect(self.options["location"]).get_schema(d).schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FlightReader(self.options["location"], self.options["flight"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FlightSource)
