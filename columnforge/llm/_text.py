"""Vectorised work on Arrow text columns: chunks of bounded size, word boundaries, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most bytes of text handled at once; a longer single text is a chunk of its own.
CHUNK = 1 << 20
U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


BYTE_VALUES = _table(20240817)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in UTF-8.
IN_TOKEN = np.ones(256, dtype=bool)
IN_TOKEN[[0x20, *range(0x09, 0x0E)]] = False
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text holds about `limit` bytes at most, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after another (null: none), and n + 1 offsets."""
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(buf: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all texts, and n + 1 offsets of each text's words."""
    mask = inside[buf]
    if not len(mask):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    edge = at[(at > 0) & (at < len(mask))]
    first[edge] |= mask[edge]
    last[edge - 1] |= mask[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                row = np.full(size, base & _MASK, U64)
                row[0] = 1
                _powers[k] = np.multiply.accumulate(row)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over 2^64 by prefix sums, then a finaliser.

    It depends on the bytes alone. Long buffers go in blocks, so the tables of powers stay small.
    """
    out = np.empty(len(starts), U64)
    block, begin = 1 << 20, 0
    with np.errstate(over="ignore"):
        while begin < len(starts):
            base = int(starts[begin])
            end = max(begin + 1, int(np.searchsorted(ends, base + block, "right")))
            size = int(ends[end - 1]) - base
            power, inverse = _power(size + 1)
            sums = np.zeros(size + 1, U64)
            np.cumsum(BYTE_VALUES[buf[base : base + size]] * inverse[:size], out=sums[1:])
            s, e = starts[begin:end] - base, ends[begin:end] - base
            out[begin:end] = (sums[e] - sums[s]) * power[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
            begin = end
    return mix(out)


def ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(begins - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return shift + np.arange(total, dtype=np.int64)
