"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search takes one boundary after another and keeps scores for a window of the longest piece's length. When no
piece from an earlier boundary goes beyond the present one, every surviving path goes through it, and the ids up to
it are final. Should a text without such a boundary go on, the paths are traced back to the last boundary that all
share, so memory follows the window and not the text.

Scores: the piece file's own where it has log-probabilities; a file of merge ranks (as the BPE kind has) gives
-ln(rank + RANK_OFFSET). Ties go to the longest last piece. A character that no piece covers becomes
byte pieces. Pieces may begin with several space marks, but none has a mark after another character, so the first
mark of a run starts a new piece: a run and the word after it are searched as one unit, and equal units are encoded
once. A space mark in the text itself is written as bytes, so decoding returns every text exactly.

Defined cases: null and empty text have no ids and decode to an empty text; repeated rows are encoded each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import chunks, ranges, text_bytes

SPACE = "▁"
RANK_OFFSET = 10.0
BYTE_COST = 10.0
MEMORY = 400_000
#: And characters of those words.
MEMORY_CHARS = 16 << 20
CHUNK = 4 << 20


class Pieces:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        ranked = all(s <= 0 and s == int(s) for s in scores)
        byte = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i) and re.fullmatch(r"<0x[0-9A-F]{2}>", names[i])}
        if len(byte) < 256:
            raise ValueError("the piece file has no byte pieces")
        self.byte = [byte[b] for b in range(256)]
        self.root: list = [{}, None, -1]  # children, score, id
        self.longest = 1
        worst = 0.0
        plain: list[bytes] = [b""] * n
        bytes_ = set(self.byte)
        for i, name in enumerate(names):
            if i in bytes_:
                plain[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[i] = name.replace(SPACE, " ").encode()
                if SPACE in name.lstrip(SPACE):
                    raise ValueError("pieces that go on after a space are not supported")
                score = -math.log(-scores[i] + RANK_OFFSET) if ranked else scores[i]
                worst = min(worst, score)
                node = self.root
                for c in name:
                    node = node[0].setdefault(c, [{}, None, -1])
                node[1:] = score, i
                self.longest = max(self.longest, len(name))
        self.byte_score = worst - BYTE_COST
        self.piece_size = np.array([len(p) for p in plain], np.int64)
        self.piece_start = np.concatenate(([0], np.cumsum(self.piece_size)))[:-1]
        self.piece_bytes = np.frombuffer(b"".join(plain), np.uint8)

    def stream(self, text: Iterable[str]) -> Iterator[int]:
        """Ids of a text of marked characters, given block by block.

        Boundaries are taken in order. From each one all pieces are tried on the next `longest` characters; `far` is the
        furthest boundary that any of them has reached. A boundary that nothing has crossed is on every path.
        """
        root, byte_score, longest = self.root, self.byte_score, self.longest
        blocks, buf, ended = iter(text), "", False
        score: list[float] = [0.0]
        back: list[tuple[int, tuple[int, ...]] | None] = [(0, ())]
        i, far, look = 0, 0, 8 * longest
        while True:
            while not ended and len(buf) - i <= longest + 1:
                block = next(blocks, None)
                ended = block is None
                buf += block or ""
            n = len(buf)
            if i >= n:
                break
            s = score[i]
            if back[i] is not None:
                c = buf[i]
                single = False
                if c != "\0":
                    node, j = root, i
                    while j < n:
                        node = node[0].get(buf[j])
                        if node is None:
                            break
                        j += 1
                        if node[1] is not None:
                            single = single or j == i + 1
                            while len(score) <= j:
                                score.append(-math.inf)
                                back.append(None)
                            t = s + node[1]
                            if t > score[j]:
                                score[j], back[j] = t, (i, (node[2],))
                            if j > far:
                                far = j
                if not single:  # bytes; a literal mark has its sign before it
                    j = i + 1 + (c == "\0")
                    code = buf[j - 1].encode("utf-8", "surrogatepass")
                    while len(score) <= j:
                        score.append(-math.inf)
                        back.append(None)
                    t = s + byte_score * len(code)
                    if t > score[j]:
                        score[j], back[j] = t, (i, tuple([self.byte[b] for b in code]))
                    if j > far:
                        far = j
            i += 1
            done = 0
            if far <= i:
                done = i
            elif i >= look:  # looked at ever more rarely, so that a text whose paths never meet costs no more
                done = self._shared(back, range(i, far + 1))
                look = 2 * i
            if done:
                look = 8 * longest
                yield from self._path(back, done)
                buf, score = buf[done:], [x - score[done] for x in score[done:]]  # so that ties do not hang on what came before
                back = [(0, ()), *(b and (b[0] - done, b[1]) for b in back[done + 1 :])]
                i, far = i - done, far - done

    @staticmethod
    def _path(back: list, at: int) -> list[int]:
        out: list[tuple[int, ...]] = []
        while at:
            at, ids = back[at]
            out.append(ids)
        return [i for ids in reversed(out) for i in ids]

    @staticmethod
    def _shared(back: list, ends: Iterable[int]) -> int:
        """The last boundary on the paths to all ends that can be reached."""
        alive = {e for e in ends if back[e] is not None}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(back[last][0])
        return alive.pop()

    def encode(self, text: str) -> list[int]:
        return list(self.stream([SPACE + mark(text)])) if text else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; the first space is the mark put before every text."""
        ids = np.asarray(ids, np.int64)
        return self.piece_bytes[ranges(self.piece_start[ids], self.piece_size[ids])].tobytes()[1:]


def mark(text: str) -> str:
    if "\0" in text or SPACE in text:
        text = re.sub(f"[\0{SPACE}]", lambda m: "\0" + m[0], text)
    return text.replace(" ", SPACE)


def _units(words: pa.Array, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Of texts split at each space (offsets at): words with the spaces before them, but the first, and their offsets.

    An empty word within a text is one more space of a run, that of the word after it.
    """
    ends = np.asarray(pc.binary_length(words)) > 0
    ends[at[1:] - 1] = True  # each text has a word at least
    if ends.all():
        return words, at
    place = np.flatnonzero(ends)
    more = np.diff(place, prepend=-1) - 1
    units = words.take(pa.array(place))
    run = more > 0
    longer = pc.binary_join_element_wise(pc.binary_repeat(pa.scalar(" ", units.type), pa.array(more[run])), units.filter(pa.array(run)), pa.scalar("", units.type))
    return pc.replace_with_mask(units, pa.array(run), longer), np.concatenate(([0], np.cumsum(ends)))[at]


class Coder:
    """Pieces with a memory of words and the spaces before them."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.chars = 0
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and n + 1 offsets."""
        if len(self.slot) > MEMORY or self.chars > MEMORY_CHARS:
            self.forget()
        lists = pc.split_pattern(pc.fill_null(text.cast(pa.large_string()), ""), " ")
        at = np.asarray(lists.offsets, np.int64)
        units, at = _units(lists.flatten(), at - at[0])
        coded = units.dictionary_encode()
        names = coded.dictionary.to_pylist()
        slots = np.fromiter((self.slot.get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(slots < 0)
        if len(new):
            found = [list(self.pieces.stream((SPACE, mark(names[i])))) for i in new]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((x for ids in found for x in ids), np.int32, int(counts.sum()))
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(counts) - counts))
            self.ids, self.count = np.concatenate((self.ids, flat)), np.concatenate((self.count, counts))
            slots[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            self.slot.update((names[i], int(slots[i])) for i in new)
            self.chars += sum(len(names[i]) for i in new)
        word = slots[coded.indices.to_numpy()]
        counts = self.count[word].copy()
        empty = np.asarray(pc.equal(pc.binary_length(pc.fill_null(text.cast(pa.large_string()), "")), 0))
        counts[at[:-1][empty]] = 0  # an empty text is one empty word, and has no ids
        sums = np.concatenate(([0], np.cumsum(counts)))
        return self.ids[ranges(self.start[word], counts)], sums[at]


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _run(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks with their ids, the offsets of each text's ids, the bytes that these give, and those bytes' offsets."""
    own = coder(model)
    for part in chunks(batches, "text", CHUNK):
        ids, at = own.encode(part.column("text"))
        size = own.pieces.piece_size[ids]
        data = own.pieces.piece_bytes[ranges(own.pieces.piece_start[ids], size)]
        yield part, ids, at, data, np.concatenate(([0], np.cumsum(size)))[at]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, decoded (the text that the ids give) for each document (doc_id, text); an error where that is not the text itself."""

    def run(batches):
        for part, ids, at, data, ends in _run(batches, model):
            texts = [data[a + 1 : b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            source, place = text_bytes(part.column("text"))
            if b"".join(texts) != source.tobytes() or not np.array_equal(np.cumsum([0, *map(len, texts)]), place):
                raise ValueError("a text does not come back from its pieces")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids)), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (ids as little-endian 32-bit), text_crc32 (of the decoded bytes), exact (decoded equals the text)."""

    def run(batches):
        for part, ids, at, data, ends in _run(batches, model):
            source, place = text_bytes(part.column("text"))
            view, whole, flat = memoryview(data), memoryview(source), memoryview(ids.astype("<u4")).cast("B")
            crc, text_crc, exact = [], [], []
            for k in range(part.num_rows):
                got = view[min(ends[k] + 1, ends[k + 1]) : ends[k + 1]]
                crc.append(zlib.crc32(flat[4 * at[k] : 4 * at[k + 1]]))
                text_crc.append(zlib.crc32(got))
                exact.append(got == whole[place[k] : place[k + 1]])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(text_crc, pa.int64()), pa.array(exact, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "text_crc32", "exact"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, exact boolean")
