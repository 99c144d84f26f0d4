"""Columnar interchange files and streams as Spark data sources.

`register(spark)` makes two formats: "colipc" reads and writes files with a footer, "colstream" streams of messages.
A file is read in partitions of about `partitionBytes` (64 MB), each of whole record batches, which its task finds from the
footer; a stream has no footer, so it is one partition. Columns that Spark lacks arrive widened (see plans.types).

Options: `columns` (comma-separated) reads only those columns' buffers; `blockRows` writes record batches of so many rows; `split` = batch
makes a partition of each record batch (then the driver reads the footers); with `pushdown` = true, which needs
spark.sql.python.filterPushdown.enabled, simple filters are evaluated in the reader, before rows cross to Spark. Paths may be files, folders or URIs.

Each writing task makes one file under a hidden name; the commit renames the files of finished tasks, an abort
removes them, and overwriting removes the earlier files only at the commit.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..errors import InvalidError, SourceError
from ..plans.schema import to_spark
from ..plans.types import legalise

#: Fixed value: the magic bytes at both ends of a file.
MAGIC = b"ARROW1"
#: Bytes of a file in a partition, unless the option says otherwise.
PARTITION_BYTES = 64 << 20
SUFFIXES = {"colipc": ".arrow", "colstream": ".arrows"}


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, ValueError) as e:
        raise SourceError(f"{path!r} is neither an absolute path nor a URI") from e


def listed(path: str) -> list[str]:
    """The data files at a path, by name."""
    store, inner = open_store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise SourceError(f"no file {path}")
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner, recursive=False))
    names = sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    return [posixpath.join(path, n) for n in names]


def check_file(path: str) -> None:
    """Both magic marks must be there."""
    store, inner = open_store(path)
    size = store.get_file_info(inner).size or 0
    with store.open_input_file(inner) as f:
        if size < 2 * len(MAGIC) or f.read_at(len(MAGIC), 0) != MAGIC or f.read_at(len(MAGIC), size - len(MAGIC)) != MAGIC:
            raise SourceError(f"{path} has no magic bytes at its ends")


def _included(schema: pa.Schema, columns: list[str] | None) -> pa.ipc.IpcReadOptions | None:
    """Options that read only the wanted columns' buffers; of equal names the last column's."""
    if not columns:
        return None
    if missing := [c for c in columns if c not in schema.names]:
        raise InvalidError(f"no column {', '.join(missing)}")
    return pa.ipc.IpcReadOptions(included_fields=sorted({schema.get_all_field_indices(c)[-1] for c in columns}))


def open_file(path: str, columns: list[str] | None = None) -> pa.ipc.RecordBatchFileReader:
    check_file(path)
    store, inner = open_store(path)
    try:
        # a local file is mapped, so values are views of its pages
        source = pa.memory_map(inner) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inner)
        whole = pa.ipc.open_file(source)
        options = _included(whole.schema, columns)
        return pa.ipc.open_file(source, options=options) if options else whole
    except pa.ArrowInvalid as e:
        raise SourceError(f"{path}: {e}") from e


def open_stream(path: str, columns: list[str] | None = None) -> pa.ipc.RecordBatchStreamReader:
    store, inner = open_store(path)
    try:
        whole = pa.ipc.open_stream(store.open_input_stream(inner))
        options = _included(whole.schema, columns)
        return pa.ipc.open_stream(store.open_input_stream(inner), options=options) if options else whole
    except pa.ArrowInvalid as e:
        raise SourceError(f"{path}: {e}") from e


def legal_batch(batch: pa.RecordBatch, columns: list[str] | None) -> pa.RecordBatch:
    """The batch, validated, with Spark-legal values in the wanted columns."""
    try:
        batch.validate(full=True)
    except pa.ArrowInvalid as e:
        raise SourceError(str(e)) from e
    names = columns or batch.schema.names
    arrays = [batch.column(batch.schema.get_all_field_indices(n)[-1]) if columns else batch.column(k) for k, n in enumerate(names)]
    return pa.RecordBatch.from_arrays([legalise(a) for a in arrays], names)


@dataclass
class Block(InputPartition):
    """Part `part` of the `parts` that a file's record batches are dealt into; parts 0: all of a stream."""

    path: str
    part: int
    parts: int


_OPS = {"EqualTo": pc.equal, "GreaterThan": pc.greater, "GreaterThanOrEqual": pc.greater_equal, "LessThan": pc.less, "LessThanOrEqual": pc.less_equal}


class BatchReader(DataSourceReader):
    def __init__(self, kind: str, options: dict) -> None:
        self.kind = kind
        self.path = options["path"]
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None
        self.target = int(options.get("partitionbytes") or options.get("partitionBytes") or PARTITION_BYTES)
        self.by_batch = options.get("split") == "batch"
        self.tests: list[tuple[str, str, object]] = []

    def parts(self, path: str) -> list[Block]:
        """Parts of about the target's size, from the file's size alone: footers are read by the tasks."""
        if self.kind == "colstream":
            return [Block(path, 0, 0)]
        store, inner = open_store(path)
        if self.by_batch:
            n = open_file(path).num_record_batches
            return [Block(path, k, n) for k in range(n)]
        parts = max(1, -(-(store.get_file_info(inner).size or 0) // self.target))
        return [Block(path, k, parts) for k in range(parts)]

    def partitions(self) -> list[Block]:
        return [b for path in listed(self.path) for b in self.parts(path)] or [Block("", 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        if partition.parts:
            reader = open_file(partition.path, self.columns)
            n = reader.num_record_batches
            batches = map(reader.get_batch, range(partition.part * n // partition.parts, (partition.part + 1) * n // partition.parts))
        else:
            batches = open_stream(partition.path, self.columns)
        for batch in batches:
            batch = legal_batch(batch, self.columns)
            for name, column, value in self.tests:
                values = batch.column(column)
                keep = values.is_null() if name == "IsNull" else values.is_valid() if name == "IsNotNull" else _OPS[name](values, pa.scalar(value))
                batch = batch.filter(pc.fill_null(keep, False))
            yield batch


class FilteringReader(BatchReader):
    """Spark asks a reader with this method only while spark.sql.python.filterPushdown.enabled, and refuses it else."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = type(f).__name__
            attribute = getattr(f, "attribute", ())
            if len(attribute) == 1 and name in _OPS and isinstance(f.value, int | float | str | bool):
                self.tests.append((name, attribute[0], f.value))
            elif len(attribute) == 1 and name in ("IsNull", "IsNotNull"):
                self.tests.append((name, attribute[0], None))
            else:
                yield f


class NewFiles(DataSourceStreamReader):
    """Structured Streaming over a folder: files in order of name, each once it is there."""

    def __init__(self, kind: str, options: dict) -> None:
        self.reader = BatchReader(kind, options)

    def _names(self) -> list[str]:
        return [posixpath.basename(p) for p in listed(self.reader.path)]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        new = [posixpath.join(self.reader.path, n) for n in self._names() if start["after"] < n <= end["after"]]
        return [b for p in new for b in self.reader.parts(p)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    name: str
    rows: int


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, kind: str, options: dict, overwrite: bool) -> None:
        self.kind, self.path, self.overwrite = kind, options["path"], overwrite
        self.compression = options.get("compression")
        self.block_rows = int(options.get("blockrows") or options.get("blockRows") or 0)

    def _blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows in batches of block_rows, the last one of a task shorter."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while (n := sum(b.num_rows for b in held)) >= self.block_rows:
                whole = pa.concat_batches(held)
                yield whole.slice(0, self.block_rows)
                held = [whole.slice(self.block_rows)] if n > self.block_rows else []
        if held:
            yield pa.concat_batches(held)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inner = open_store(self.path)
        store.create_dir(inner, recursive=True)
        name = f"part-{uuid.uuid4().hex}{SUFFIXES[self.kind]}"
        out, rows, sink = None, 0, store.open_output_stream(f"{inner}/.{name}")
        with sink:
            for batch in self._blocks(iterator) if self.block_rows else iterator:
                if out is None:
                    options = pa.ipc.IpcWriteOptions(compression=self.compression)
                    out = (pa.ipc.new_stream if self.kind == "colstream" else pa.ipc.new_file)(sink, batch.schema, options=options)
                out.write_batch(batch)
                rows += batch.num_rows
            if out is not None:
                out.close()
        if out is None:
            store.delete_file(f"{inner}/.{name}")
            name = ""
        return Written(f".{name}", name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = open_store(self.path)
        old = listed(self.path) if self.overwrite and store.get_file_info(inner).type == fs.FileType.Directory else []
        for m in messages:
            if m and m.name:
                store.move(f"{inner}/{m.hidden}", f"{inner}/{m.name}")
        for path in old:
            store.delete_file(open_store(path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        store, inner = open_store(self.path)
        for m in messages:
            if m and m.name and store.get_file_info(f"{inner}/{m.hidden}").type == fs.FileType.File:
                store.delete_file(f"{inner}/{m.hidden}")


class _Ipc(DataSource):
    kind = "colipc"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def _options(self) -> dict:
        if not self.options.get("path"):
            raise InvalidError("a path is needed")
        return dict(self.options)

    def schema(self) -> T.StructType:
        options = self._options()
        files = listed(options["path"])
        if not files:
            raise SourceError(f"no files in {options['path']}")
        found = (open_stream if self.kind == "colstream" else open_file)(files[0]).schema
        out = to_spark(found)
        if options.get("columns"):
            out = T.StructType([next(f for f in reversed(out.fields) if f.name == c.strip()) for c in options["columns"].split(",")])
        return out

    def reader(self, schema: T.StructType) -> DataSourceReader:
        options = self._options()
        return (FilteringReader if options.get("pushdown") == "true" else BatchReader)(self.kind, options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return NewFiles(self.kind, self._options())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BatchWriter(self.kind, self._options(), overwrite)


class IpcFiles(_Ipc):
    kind = "colipc"


class IpcStreams(_Ipc):
    kind = "colstream"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IpcFiles)
    spark.dataSource.register(IpcStreams)
