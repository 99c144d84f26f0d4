"""Token-id files: one id array per shard, document boundaries in Elias-Fano code.

Layout of a shard, little-endian: the magic bytes; the ids of all documents one after another (uint16 if the
vocabulary fits, else uint32); the Elias-Fano code of the n + 1 boundaries; that of the document ids; a footer
of FOOTER with the places of the parts. The first documents, `n_null` of them, have no id.

Elias-Fano splits each value of an ascending sequence: the low bits are stored plainly, the high parts as a bit
vector with a one for each value. Every SELECT-th one's place is stored, so the i-th value is found from one
sample and a few machine words, in about 2 + log2(universe / n) bits a value.

Shards follow each other in ascending order of id (nulls first, copies of an id by the hash of their text). A task
that runs again writes a file of its own; only the files named in the manifest of finished tasks count.

Defined cases: null text is encoded as empty, so it holds the end id alone; repeated rows are stored each; an
empty table makes no shard and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, stage
from ._text import chunks, ranges

MAGIC = b"CFIDS\x01\0\0"
#: ids, boundaries, document ids: offsets; documents, ids, nulls, id width.
FOOTER = struct.Struct("<8Q")
SELECT = 256
SHARD_BYTES = 48 << 20
#: Words that a worker remembers the ids of.
MEMORY = 400_000
#: And characters of those words.
MEMORY_CHARS = 16 << 20
#: Words encoded as one text, and signs that may end such a word.
JOINED = 256
SIGNS = tuple(".,!?:")
CHUNK = 4 << 20


class EliasFano:
    """An ascending sequence of n integers in [0, universe]."""

    HEAD = struct.Struct("<4Q")

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 * 8, np.uint8)
        if bits:
            plain = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
            packed = np.packbits(plain, bitorder="little")
            low[: len(packed)] = packed
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (universe >> bits) + n + 1
        marks = np.zeros((size + 63) // 64 * 64, np.uint8)
        marks[ones] = 1
        wide = np.uint32 if size < 1 << 32 else np.uint64
        return cls(n, universe, bits, low, np.packbits(marks, bitorder="little"), ones[::SELECT].astype(wide))

    def tobytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.universe, self.low_bits, self.samples.itemsize)
        sizes = struct.pack("<3Q", self.low.nbytes, self.high.nbytes, self.samples.nbytes)
        return head + sizes + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        n, universe, bits, width = cls.HEAD.unpack_from(data)
        sizes = struct.unpack_from("<3Q", data, cls.HEAD.size)
        at = cls.HEAD.size + 24
        parts = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, np.uint32 if width == 4 else np.uint64), strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, universe, bits, *parts)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bit = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bit.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SELECT]), i % SELECT
        byte = place >> 3
        word = int(self.high[byte]) & (0xFF << (place & 7))
        while (here := word.bit_count()) <= left:
            left -= here
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return ((one - i) << self.low_bits) | int(self._lows(np.array([i]))[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        out = (ones - i).astype(np.uint64) << np.uint64(self.low_bits)
        for begin in range(0, self.n, 1 << 16):
            out[begin : begin + (1 << 16)] |= self._lows(i[begin : begin + (1 << 16)])
        return out.astype(np.int64)


class Encoder:
    """Ids of texts, word by word: white space of ASCII always parts the tokenizer's words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.uint16 if self.width == 2 else np.uint32
        # of a vocabulary that marks words' ends: which ids end one
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        if not self.ends.any():
            self.ends = None
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.chars = 0
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's number of ids."""
        if len(self.slot) > MEMORY or self.chars > MEMORY_CHARS:
            self.forget()
        lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.large_string()), ""))
        at = np.asarray(lists.offsets, np.int64)
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        slots = np.fromiter((self.slot.get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(slots < 0)
        if len(new):
            flat, start, counts = self._fresh([names[i] for i in new])
            self.start = np.concatenate((self.start, len(self.ids) + start))
            self.ids, self.count = np.concatenate((self.ids, flat)), np.concatenate((self.count, counts))
            slots[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            self.slot.update((names[i], int(slots[i])) for i in new)
            self.chars += sum(len(names[i]) for i in new)
        word = slots[coded.indices.to_numpy()]
        counts = self.count[word]
        sums = np.concatenate(([0], np.cumsum(counts)))
        return self.ids[ranges(self.start[word], counts)], np.diff(sums[at - at[0]])


    def _fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, and where each one's begin and how many they are.

        Words of letters alone, or of letters and one sign, are encoded many at a time: the ids that end a part tell
        them apart. Where the number of parts is not as expected, the words are encoded one by one.
        """
        parts = np.fromiter((1 if w.isalpha() else 2 if w[-1:] in SIGNS and w[:-1].isalpha() else 0 for w in words), np.int8, len(words))
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        single = [np.flatnonzero(parts == 0)] if self.ends is not None else [np.arange(len(words))]
        for n in (1, 2) if self.ends is not None else ():
            own = np.flatnonzero(parts == n)
            groups = [own[i : i + JOINED] for i in range(0, len(own), JOINED)]
            texts = [" ".join([words[i] for i in g]) for g in groups]
            for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.kind)
                last = np.flatnonzero(self.ends[ids])
                if len(last) != n * len(g) or last[-1] != len(ids) - 1:
                    single.append(g)
                else:
                    counts[g] = np.diff(last[n - 1 :: n], prepend=-1)
                    found.append((g, ids))
        rest = np.concatenate(single)
        for i, e in zip(rest.tolist(), self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            counts[i] = len(e.ids)
            found.append((np.array([i]), np.array(e.ids, self.kind)))
        order = np.concatenate([g for g, _ in found])
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate([ids for _, ids in found]), start, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    where = TaskContext.get().partitionId()
    coder, out, lengths, ids = encoder(tokenizer), None, [], []
    name = f"{folder}/shard-{where:06d}-{uuid.uuid4().hex[:8]}.ids"
    store, inner = fs.FileSystem.from_uri(name)
    for part in chunks(batches, "text", CHUNK):
        flat, counts = coder.encode(part.column("text"))
        if out is None:
            store.create_dir(inner.rpartition("/")[0], recursive=True)
            out = store.open_output_stream(inner)
            out.write(MAGIC)
        ends = np.cumsum(counts)
        whole = np.insert(flat, ends, end_id).astype(coder.kind)
        out.write(whole.tobytes())
        lengths.append(counts + 1)
        ids.append(part.column("doc_id"))
    if out is None:
        return
    total = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
    names = pa.concat_arrays(ids)
    null = names.null_count
    names = names.drop_null().to_numpy()
    low = int(names[0]) if len(names) else 0
    bounds = EliasFano.build(total, int(total[-1])).tobytes()
    keys = EliasFano.build((names - low).astype(np.uint64), int(names[-1]) - low if len(names) else 0).tobytes()
    first = len(MAGIC) + int(total[-1]) * coder.width
    out.write(bounds + keys)
    out.write(FOOTER.pack(first, first + len(bounds), len(total) - 1, int(total[-1]), null, coder.width, low % (1 << 64), len(keys)))
    out.close()
    yield pa.RecordBatch.from_pylist([{"shard": where, "path": name, "n_docs": len(total) - 1, "n_ids": int(total[-1])}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write shards of the encoded documents in ascending order of doc_id; returns the manifest with each shard's first id."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # copies of a row are alike, so a number of their own may deal them out
    order = [F.asc_nulls_first("doc_id"), F.col("h"), F.col("copy")]
    rows = rows.withColumn("copy", F.monotonically_increasing_id())
    sorted_rows = rows.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order)
    made = stage(sorted_rows.mapInArrow(lambda b: _write(b, folder, tokenizer, end_id), "shard int, path string, n_docs long, n_ids long"), "manifest")
    rows, start = [], 0
    for r in made.orderBy("shard").collect():  # one short row for each shard
        rows.append((r.shard, r.path, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return spark.createDataFrame(rows, "shard int, path string, n_docs long, n_ids long, start long")


@dataclass
class Shard:
    """An open shard; ids of any document by two look-ups."""

    path: str

    def __post_init__(self) -> None:
        store, inner = fs.FileSystem.from_uri(self.path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        bounds, keys, self.n, self.n_ids, self.nulls, self.width, low, length = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.bounds = EliasFano.frombytes(self.file.read_at(keys - bounds, bounds))
        self.keys = EliasFano.frombytes(self.file.read_at(length, keys))
        self.low = low - (1 << 64) if low >> 63 else low

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.keys.values() + self.low).tolist()

    def ids(self, i: int, j: int | None = None) -> np.ndarray:
        """The ids of document i, or of documents i to j - 1 together."""
        a, b = self.bounds.select(i), self.bounds.select(i + 1 if j is None else j)
        return np.frombuffer(self.file.read_at((b - a) * self.width, len(MAGIC) + a * self.width), self.kind)


def _read(batches: Iterator[pa.RecordBatch], chunk: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            shard = Shard(path)
            names, bounds = shard.doc_ids(), shard.bounds.values()
            i = 0
            while i < shard.n:
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + chunk, "right")) - 1)
                ids = shard.ids(i, j).astype("<u4")
                at = bounds[i : j + 1] - bounds[i]
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names[i:j], pa.int64()), pa.array(bounds[i:j] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                i = j


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards, a task for each shard."""
    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
