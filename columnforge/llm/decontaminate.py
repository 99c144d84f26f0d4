"""Benchmark decontamination by a positional inverted index over the training documents.

The index is written to the shared folder and sharded by document: a row holds some SHARD bytes of text as its terms
(64-bit hashes of words, ascending), how often each occurs, and the positions of each, ascending and as gaps. Building it moves no
posting between tasks; any number of sets of test items are then searched for without the texts.

The counts of the test items' terms are summed over all shards. A phrase query starts at the posting list of the term that is
the rarest in the whole corpus, shifts it by the term's offset, and intersects it with the next rarest ones. A proximity
query starts there too and asks for all different terms of a window, in any order, within SPAN consecutive words.

Test items are a query set: they go to the tasks in blocks of at most BLOCK_BYTES bytes, each block as arrays, its windows as places in
one array of terms. More blocks are more passes over the index.

Defined cases: null text has no words; an empty table gives no rows; an item without words is left out; an
item with a null id still marks words but is not listed; repeated ids are listed once; repeated rows are answered each; other columns of
the documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stage
from ._text import IN_TERM, LOWER, U64, chunks, mix, ranges, text_bytes, word_hashes, words

WINDOW = 10
SPAN = 20
#: Bytes of text in a shard of the index, or one document.
SHARD = 8 << 20
#: Most bytes of test items sent to all tasks at once; more go in blocks of this size.
BLOCK_BYTES = 32 << 20
#: Candidates, and windows, that are looked at together.
LIMIT = 1 << 20
INDEX = "shard long, doc_id array<long>, h array<long>, words binary, terms binary, counts binary, gaps binary"
SCHEMA = "shard long, place int, doc_id long, h long, n_words long, n_hit long, items array<string>, near array<string>, spans array<struct<start:long,end:long>>"


def _terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and n + 1 offsets."""
    buf, at = text_bytes(text)
    buf = LOWER[buf]
    starts, ends, ptr = words(buf, at, IN_TERM)
    return word_hashes(buf, starts, ends), ptr


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _joined(batches):
        hashes, ptr = _terms(part.column("text"))
        terms, code, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        postings = np.argsort(code, kind="stable")
        gaps = np.diff(postings, prepend=0)
        first = (np.cumsum(counts) - counts)[: len(terms)]
        gaps[first] = postings[first]  # each list begins with a position
        name = int(mix(np.array([hashes.sum(dtype=U64) + U64(part.num_rows)], U64)).view(np.int64)[0])
        lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("doc_id", "h")]
        data = (np.diff(ptr).astype(np.uint32), terms, counts.astype(np.uint32), gaps.astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array([name]), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in data)], ["shard", "doc_id", "h", "words", "terms", "counts", "gaps"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about SHARD bytes of text, or one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in chunks(batches, "text", SHARD):
        own = int(text_bytes(part.column("text"))[1][-1])
        if held and size + own > SHARD:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield pa.concat_batches(held)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of the documents (doc_id, text), a row for each shard, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    return stage(rows.mapInArrow(_indexed, INDEX), "index")


class Shard:
    """An open shard: words of the shard are numbered through all of its documents."""

    def __init__(self, row: dict) -> None:
        size = np.frombuffer(row["words"], np.uint32).astype(np.int64)
        self.name, self.doc_id, self.h = row["shard"], row["doc_id"], row["h"]
        self.ptr = np.concatenate(([0], np.cumsum(size)))
        self.doc = np.repeat(np.arange(len(size)), size)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.count = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.count)))
        gaps = np.frombuffer(row["gaps"], np.uint32).astype(np.int64)
        sums = np.cumsum(gaps)
        before = np.where(self.begin[:-1] > 0, sums[self.begin[:-1] - 1], 0) if len(gaps) else np.zeros(0, np.int64)
        self.postings = sums - np.repeat(before, self.count)
        self.term = np.empty(len(gaps), np.int32)
        self.term[self.postings] = np.repeat(np.arange(len(self.terms)), self.count)
        #: Postings as term and position in one number, ascending.
        self.keys = np.repeat(np.arange(len(self.terms)) << 32, self.count) | self.postings

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """This shard's number of each term; -1: none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def candidates(self, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In blocks of about LIMIT: (row, position) of each posting of the first term of each row of `own`."""
        total = np.concatenate(([0], np.cumsum(self.count[own[:, 0]])))
        first = 0
        while first < len(own):
            last = max(first + 1, int(np.searchsorted(total, total[first] + LIMIT, "right")) - 1)
            rare = own[first:last, 0]
            yield np.repeat(np.arange(first, last), self.count[rare]), self.postings[ranges(self.begin[rare], self.count[rare])]
            first = last

    def phrases(self, own: np.ndarray, offset: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, first word) of each occurrence of the terms `own` of a row, rarest first, at the offsets of theirs."""
        m, n = own.shape[1], len(self.term)
        for which, at in self.candidates(own):
            at = at - offset[which, 0]
            ok = (at >= 0) & (at + m <= n)
            which, at = which[ok], at[ok]
            for k in range(1, m):
                ok = self.term[at + offset[which, k]] == own[which, k]
                which, at = which[ok], at[ok]
            ok = self.doc[at] == self.doc[at + m - 1]
            yield which[ok], at[ok]

    def _next(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first position of each term from `at` on; beyond all words if there is none."""
        place = np.minimum(np.searchsorted(self.keys, (term.astype(np.int64) << 32) | at), len(self.keys) - 1)
        found = self.keys[place]
        return np.where((found >> 32 == term) & ((found & 0xFFFFFFFF) >= at), found & 0xFFFFFFFF, len(self.term) + (1 << 31))

    def near(self, own: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, position of its rarest term) wherever all terms `own` of a row lie within `span` words."""
        for which, at in self.candidates(own):
            for k in range(1, own.shape[1]):
                doc = self.doc[at]
                ok = self._next(own[which, k], np.maximum(at - span + 1, self.ptr[doc])) <= np.minimum(at + span, self.ptr[doc + 1]) - 1
                which, at = which[ok], at[ok]
            doc = self.doc[at]
            hit = np.zeros(len(at), bool)
            for back in range(span if own.shape[1] > 1 else 1):
                left = np.flatnonzero(~hit & (at - back >= self.ptr[doc]))
                begin = at[left] - back
                for k in range(1, own.shape[1]):
                    ok = self._next(own[which[left], k], begin) <= np.minimum(begin + span, self.ptr[doc[left] + 1]) - 1
                    left, begin = left[ok], begin[ok]
                hit[left] = True
            yield which[hit], at[hit]


class Phrases:
    """The windows of a block of test items: places in one array of term numbers, and the items of each window."""

    def __init__(self, items: pa.Table, window: int) -> None:
        names = items.column(0).combine_chunks().cast(pa.string())
        hashes, ptr = _terms(items.column(1).combine_chunks())
        self.terms, ids = np.unique(hashes, return_inverse=True)
        self.term = ids.astype(np.int32)
        self.counts = np.zeros(len(self.terms), np.int64)
        del hashes, ids
        self.ids = pc.sort_indices(found := pc.unique(names.drop_null()))
        self.ids = found.take(self.ids)
        number = pc.fill_null(pc.index_in(names, self.ids), -1).to_numpy().astype(np.int64)
        size = np.diff(ptr)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for m in np.unique(np.minimum(size[size > 0], window)).tolist():
            own = np.flatnonzero((size == m) if m < window else (size >= window))
            many = size[own] - m + 1
            start, owner = ranges(ptr[own], many).astype(np.int32), np.repeat(number[own].astype(np.int32), many)
            marks = np.zeros((2, len(start)), U64)
            with np.errstate(over="ignore"):
                for j in range(m):
                    value = self.term[start + j].astype(U64) + U64(1)
                    for h, by in zip(marks, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), strict=True):
                        h *= U64(by)
                        h += value
                        h[:] = mix(h)
                    del value
            order = np.lexsort((owner, *marks))  # equal windows, of 128 equal bits, side by side
            for h in marks:
                h[:] = h[order]
            owner = owner[order]
            new = np.ones(len(order), bool)
            new[1:] = (marks[:, 1:] != marks[:, :-1]).any(axis=0)
            keep = owner >= 0
            keep[1:] &= new[1:] | (owner[1:] != owner[:-1])
            which = np.cumsum(new) - 1
            at = np.concatenate(([0], np.cumsum(np.bincount(which[keep], minlength=int(new.sum())))))
            self.groups.append((m, start[order][new].astype(np.int64), at, owner[keep]))

    def live(self, shard: Shard) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the windows whose terms the shard has: length, offsets from the rarest term on, the shard's term numbers in that order, and the windows' items."""
        number = shard.numbers(self.terms)
        for m, start, at, owner in self.groups:
            for first in range(0, len(start), LIMIT // 4):
                own = np.arange(first, min(first + LIMIT // 4, len(start)))
                for j in range(m):
                    own = own[number[self.term[start[own] + j]] >= 0]
                if not len(own):
                    continue
                ids = self.term[start[own][:, None] + np.arange(m)]
                offset = np.lexsort((ids, self.counts[ids]), axis=1)
                yield m, offset, number[np.take_along_axis(ids, offset, 1)], own, at, owner


def _count(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            own, count = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.uint32)
            _, a, b = np.intersect1d(own, terms, assume_unique=True, return_indices=True)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(count[a].astype(np.int64))], ["term", "n"])


def _pairs(found: list[np.ndarray], n: int, ids: pa.Array) -> pa.ListArray:
    """Lists of item ids of each document, from pairs (document, item)."""
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    per = np.concatenate(([0], np.cumsum(np.bincount(pairs[0], minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per), ids.take(pa.array(pairs[1])))


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases, span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            n, cover = len(shard.doc_id), np.zeros(len(shard.term) + 1, np.int64)
            exact: list[np.ndarray] = []
            near: list[np.ndarray] = []

            def owners(which: np.ndarray, at: np.ndarray, own: np.ndarray, begin: np.ndarray, owner: np.ndarray, shard: Shard = shard) -> np.ndarray:
                window = own[which]
                many = begin[window + 1] - begin[window]
                return np.stack([np.repeat(shard.doc[at], many), owner[ranges(begin[window], many)].astype(np.int64)])

            for m, offset, terms, own, begin, owner in phrases.live(shard):
                for which, at in shard.phrases(terms, offset):
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + m, -1)
                    exact.append(owners(which, at, own, begin, owner))
                for which, at in shard.near(terms, span):
                    near.append(owners(which, at, own, begin, owner))
            hit = np.cumsum(cover)[:-1] > 0
            sums = np.concatenate(([0], np.cumsum(hit)))
            edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
            inner = shard.ptr[1:-1]
            inner = inner[(inner > 0) & (inner < len(hit))]
            cut = np.unique(inner[hit[inner] & hit[inner - 1]]) if len(hit) else inner  # a run never spans two documents
            begins, ends = np.sort(np.concatenate((np.flatnonzero(edge == 1), cut))), np.sort(np.concatenate((np.flatnonzero(edge == -1), cut)))
            run = shard.doc[begins] if len(begins) else begins
            per = np.concatenate(([0], np.cumsum(np.bincount(run, minlength=n)))).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(begins - shard.ptr[run]), pa.array(ends - shard.ptr[run])], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard.name] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(shard.doc_id, pa.int64()), pa.array(shard.h, pa.int64()), pa.array(np.diff(shard.ptr)),
                    pa.array(sums[shard.ptr[1:]] - sums[shard.ptr[:-1]]), _pairs(exact, n, phrases.ids), _pairs(near, n, phrases.ids), pa.ListArray.from_arrays(pa.array(per), spans),
                ],
                ["shard", "place", "doc_id", "h", "n_words", "n_hit", "items", "near", "spans"],
            )


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[pa.Table]:
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // limit))
    for k in range(blocks):
        yield (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)).toArrow()


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int = SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per indexed document: doc_id, h (of its text), n_words, n_hit, items and near (ids as sorted strings), spans of hit words."""
    if window < 1:
        raise ValueError("a window has at least one word")
    columns, context = ["doc_id", "h", "n_words", "n_hit", "items", "near", "spans"], index.sparkSession.sparkContext
    parts = []
    blocks = list(_blocks(benchmark, block_bytes)) if benchmark is not None else []
    for items in blocks:
        phrases = Phrases(items, window)
        terms = context.broadcast(phrases.terms)
        counts = index.select("terms", "counts").mapInArrow(lambda b, terms=terms: _count(b, terms.value), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        phrases.counts[counts["term"].to_numpy()] = counts["n"].to_numpy()
        terms.destroy()
        held = context.broadcast(phrases)
        found = index.mapInArrow(lambda b, held=held: _search(b, held.value, span), SCHEMA)
        if len(blocks) == 1:
            return found.select(columns)
        parts.append(stage(found, "contamination"))
        held.destroy()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    whole = whole.groupBy("shard", "place", "doc_id", "h", "n_words").agg(both("items"), both("near"), both("spans"))
    joined = F.aggregate(
        "spans",
        F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    whole = whole.withColumn("spans", joined).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
    return whole.select(columns)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int = SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document (doc_id, text), as `search` gives it."""
    return search(build_index(docs), benchmark, window, span, block_bytes)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold a window of a test item; those without an id are told apart by their text."""
    hit = stage(contamination(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "hit")
    inner = [c if c in ("doc_id", "text") else f"_{k}" for k, c in enumerate(docs.columns)]
    own = docs.toDF(*inner)
    left = own.join(hit, own["doc_id"].cast("long").eqNullSafe(hit["_id"]) & F.xxhash64(own["text"].cast("string")).eqNullSafe(hit["_h"]), "left_anti")
    return left.select(*(F.col(a).alias(b) for a, b in zip(inner, docs.columns, strict=True)))
