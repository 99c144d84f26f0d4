"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed from left to right into the
longest phrases that occur in the language's text; the fewer phrases, weighted by log2 of the size of the
language's text and divided by the length, the better the language explains it.

The automata are over lower-cased UTF-8 bytes in which each ASCII byte other than a letter is a space. All
blocks of BLOCK bytes of a chunk of documents are parsed side by side: a step takes one byte of each block and
one look-up in a dense transition table, whose entries already hold the restart after a mismatch. A block's parse
begins OVERLAP bytes before it, so that it falls in step with the phrases that run into it, and counts those that end in the block.

The fit is on a bounded sample of labelled rows: of each language SAMPLES texts at most, drawn by hash over all of them, each text
once, and of each text a passage at a place drawn by hash. A language gives at most TRAIN_BYTES bytes, and all together about
TOTAL_BYTES: with more languages each gives fewer, but LEAST_BYTES, and none is left out.

Defined cases: null text and text without letters give `und` and score 0; without any labelled text all rows
do; of languages with equal results the first by name wins with score 0; a null label is not learned; an empty
table gives no rows; repeated rows are answered alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stage
from ._text import chunks, text_bytes

TRAIN_BYTES = 32_000
TOTAL_BYTES = 400_000
LEAST_BYTES = 1_000
SAMPLES = 128
BLOCK = 1024
OVERLAP = 64
#: An entry's two highest bits: how many phrases end there.
_ENDS = np.uint32(30)
_STATE = np.uint32((1 << 30) - 1)

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the states; state 0 is the start and no transition leads to it."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


@dataclass
class Automata:
    """names[k]'s table k: entry state + symbol is the next state, and the number of phrases that end there in its highest bits."""

    names: list[str]
    symbols: np.ndarray
    width: int
    tables: list[np.ndarray]
    bits: list[float]

    @classmethod
    def build(cls, texts: dict[str, bytes]) -> Automata:
        names = sorted(texts)
        seen = sorted({x for t in texts.values() for x in t})
        symbols = np.zeros(256, np.uint32)  # 0: a byte that no text has
        symbols[seen] = np.arange(1, len(seen) + 1)
        width, tables, bits = len(seen) + 1, [], []
        for name in names:
            go = suffix_automaton(texts[name])
            table = np.zeros((len(go), width), np.uint32)
            for s, edges in enumerate(go):
                for c, q in edges.items():
                    table[s, symbols[c]] = q * width
            restart = table[0].copy()
            # a phrase ends at a mismatch and the next one begins; a byte that the text lacks is a phrase of its own
            alone = (restart == 0).astype(np.uint32)
            for s in range(1, len(go)):
                miss = table[s] == 0
                table[s, miss] = restart[miss] | (1 + alone[miss]) << _ENDS
            table[0] = restart | alone << _ENDS
            tables.append(table.reshape(-1))
            bits.append(float(np.log2(len(texts[name]) + 1)))
        return cls(names, symbols, width, tables, bits)

    def phrases(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, languages): phrases of each text, cleaned bytes data[at[i]:at[i + 1]]."""
        size = np.diff(at)
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(size)), blocks)
        begin = np.concatenate(([0], np.cumsum(blocks)))[:-1]
        place = np.arange(len(owner)) - begin[owner]
        start = at[:-1][owner] + place * BLOCK
        lead = np.where(place > 0, OVERLAP, 0)
        length = np.minimum(BLOCK, at[1:][owner] - start) + lead
        last = place == blocks[owner] - 1
        order = np.argsort(-length, kind="stable")
        start, lead, length, last, owner = (start - lead)[order], lead[order], length[order], last[order], owner[order]
        code = self.symbols[data]
        out = np.zeros((len(size), len(self.names)), np.int64)
        live = np.searchsorted(-length, -np.arange(1, BLOCK + OVERLAP + 1), "right") if len(length) else []
        for k, table in enumerate(self.tables):
            state, count = np.zeros(len(start), np.uint32), np.zeros(len(start), np.uint32)
            for t, n in enumerate(live):
                if not n:
                    break
                s = table.take(state[:n] + code.take(start[:n] + t))
                count[:n] += s >> _ENDS if t >= OVERLAP else (s >> _ENDS) * (lead[:n] == 0)
                state[:n] = s & _STATE
            out[:, k] = np.bincount(owner, count + ((state > 0) & last), len(size))
        return out


def _training(docs: DataFrame, usable: Column, train_bytes: int) -> dict[str, bytes]:
    """Text of each language: of SAMPLES hash buckets of texts the first each, an equal share of bytes from somewhere in it."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(SAMPLES)))
    picks = stage(rows.groupBy("lang", "bucket").agg(F.min("h").alias("h")), "picks")
    languages = picks.select("lang").distinct().count()  # a row for each label
    if not languages:
        return {}
    most = min(train_bytes, max(LEAST_BYTES, TOTAL_BYTES // languages))
    share = max(1, most // SAMPLES)
    # a language with few texts gives more of each; a picked text may have many copies, of which one passage is moved
    have = picks.groupBy("lang").agg(F.count("*").alias("texts"))
    size = F.greatest(F.lit(share), F.floor(F.lit(most) / F.col("texts")).cast("int"))
    found = rows.join(picks.join(have, "lang").withColumn("size", size), ["lang", "bucket", "h"])
    start = F.pmod(F.xxhash64("h"), F.greatest(F.char_length("text") - F.col("size") + 1, F.lit(1))).cast("int")
    found = found.groupBy("lang", "h", "size").agg(F.max(F.substring(F.col("text"), start + 1, F.col("size"))).alias("t")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.h)):
        text = _clean(pa.array([r.t]))[0].tobytes()[: r.size]
        if text.strip():
            out[r.lang] = out[r.lang] + b" " + text if r.lang in out else text
    return out


def _clean(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(pc.utf8_lower(text.cast(pa.large_string())))
    return _CLEAN[data], at


def fit(docs: DataFrame, usable: Column | None = None, train_bytes: int = TRAIN_BYTES) -> Automata:
    """Automata from labelled rows (text, lang) for which `usable` holds."""
    return Automata.build(_training(docs, F.lit(True) if usable is None else usable, train_bytes))


def _predict(batches: Iterator[pa.RecordBatch], model: Automata) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.names, "und"], object)
    for part in chunks(batches, "text"):
        data, at = _clean(part.column("text"))
        size = np.diff(at)
        best, score = np.full(len(size), len(model.names)), np.zeros(len(size))
        if model.names and len(data):
            cost = model.phrases(data, at) * np.array(model.bits) / np.maximum(size, 1)[:, None]
            letters = pc.fill_null(pc.match_substring_regex(part.column("text"), r"\pL"), False).to_numpy(zero_copy_only=False)
            win = np.argmin(cost, axis=1)
            low = cost[np.arange(len(size)), win]
            rest = cost.copy()
            rest[np.arange(len(size)), win] = np.inf
            second = rest.min(axis=1) if len(model.names) > 1 else np.full(len(size), np.inf)
            best = np.where(letters, win, best)
            score = np.where(letters, np.clip(1 - low / np.maximum(second, 1e-12), 0, 1), 0)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, model: Automata) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(lambda batches: _predict(batches, held.value), "doc_id long, held_out boolean, lang_pred string, score double")
