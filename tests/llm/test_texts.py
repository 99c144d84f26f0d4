"""Language id, token files, chat, SentencePiece: against brute force and round trips."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from columnforge.llm import chat_format, language_id, sentencepiece_viterbi, token_files
from columnforge.llm.queries import op1_language_id, op2_token_files, op8_sentencepiece, table


# language identification


def phrase_ends(text: bytes, trained: bytes) -> tuple[list[int], bool]:
    """Cross parsing by substring search: where phrases end (for a byte never seen: where it is), and whether one is open at the end."""
    ends, at = [], 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in trained:
            n += 1
        if text[at : at + 1] not in trained:
            ends.append(at)
        elif at + n < len(text):
            ends.append(at + n)
        else:
            return ends, True
        at += n
    return ends, False


def test_parsing_equals_substring_search():
    rng = random.Random(1)
    trained = {n: bytes(rng.choice(letters) for _ in range(400)) for n, letters in (("x", b"ab c"), ("y", b"bcd "))}
    model = language_id.Automata.build(trained)
    texts = [bytes(rng.choice(b"abcdz ") for _ in range(n)) for n in (0, 1, 2, 50, 1023, 1024, 1025, 3000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = model.phrases(data, at)
    for k, t in enumerate(texts):
        for j, name in enumerate(model.names):
            count = 0
            for b in range(0, len(t), language_id.BLOCK):
                lead = language_id.OVERLAP if b else 0
                ends, is_open = phrase_ends(t[b - lead : b + language_id.BLOCK], trained[name])
                count += sum(x >= lead for x in ends) + (is_open and b + language_id.BLOCK >= len(t))
            whole, is_open = phrase_ends(t, trained[name])
            assert got[k, j] == count and abs(count - len(whole) - is_open) <= len(t) // language_id.BLOCK


def test_training_text(spark, make, monkeypatch):
    """Passages from all places of texts, no language left out, within the bounds."""
    monkeypatch.setattr(language_id, "TOTAL_BYTES", 20_000)
    rng = random.Random(4)
    body = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400))
    docs = make([(k, "head " * 100 + body() + " end" * 100, f"l{k % 300:03d}", "s") for k in range(900)])
    found = language_id._training(docs, F.lit(True), 32_000)
    assert len(found) == 300 and all(0 < len(x) <= language_id.LEAST_BYTES + 10 for x in found.values())
    share = sum(x.count(b"head") for x in found.values()) * 5 / sum(map(len, found.values()))
    assert share < 0.4 and sum(b"end end" in x for x in found.values()) > 10


def test_long_text_equals_its_parts(spark, make):
    """A text of megabytes, in blocks, has the phrases of its whole parse but for a few at the blocks' ends."""
    rng = random.Random(9)
    lexicon = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    text = " ".join(rng.choice(lexicon) for _ in range(40_000))
    model = language_id.Automata.build({"a": text[:3000].encode(), "b": b"zyx wvu"})
    data = np.frombuffer(text.encode(), np.uint8)
    ends, is_open = phrase_ends(text.encode(), text[:3000].encode())
    got = model.phrases(data, np.array([0, len(data)]))[0, 0]
    assert abs(got - len(ends) - is_open) <= 0.002 * got
    assert [r.lang_pred for r in language_id.identify(make([text]), model).collect()] == ["a"]


def test_held_out_accuracy(spark, sf_dir):
    rows = op1_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, make, odd):
    docs = make(odd)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[4][0] in ("de", "en", "fr")
    assert got[None][0] in ("de", "en", "fr")
    nothing = language_id.fit(docs, F.lit(False))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), nothing).count() == 0
    tie = language_id.fit(make([(1, "same words", "b", "s"), (2, "same words", "a", "s")]))
    assert [tuple(r)[2:] for r in language_id.identify(make(["same words"]), tie).collect()] == [("a", 0.0)]


# token files


@pytest.mark.parametrize("n,universe", [(0, 0), (1, 0), (1, 10**12), (5, 3), (1000, 999), (777, 10**9), (3000, 2**40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe + 1, n))
    coded = token_files.EliasFano.frombytes(token_files.EliasFano.build(values, universe).tobytes())
    assert coded.values().tolist() == values.tolist() and [coded.select(i) for i in range(n)] == values.tolist()
    for i in (-1, n):
        with pytest.raises(IndexError):
            coded.select(i)
    if n == 3000:  # near-minimal: 2 bits and the low bits each, and the samples
        bits = 8 * len(coded.tobytes()) / n
        assert bits < 2 + math.log2(universe / n) + 3


def test_word_cache_equals_the_tokenizer(bpe):
    own = token_files.encoder(bpe)
    texts = ["İstanbul foo", "á b ́x", "<|endoftext|> x<|startoftext|>y", "don't I'll 've", "x\x1cy z\x85w v", "ΑΣ ΟΔΟΣ.", "", "  ", "x.. y.! 12 a1.", "한국어 한", "🙂 a🙂.", "ﬁ ﬃ.", "Ǆ. ŉ'n", "a\x0bb\x0cc", "Word. word, WORD: word! word?"]
    flat, counts = own.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for k, e in enumerate(own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
        assert flat[ends[k] - counts[k] : ends[k]].tolist() == e.ids


def test_token_files_equal_brute_force(spark, sf_dir, make, odd, bpe):
    tok = token_files.encoder(bpe).tokenizer

    def want(rows):
        out, start = [], 0
        for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
            out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        return out

    docs = table(spark, sf_dir, "documents")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in op2_token_files(spark, sf_dir).collect()), key=key)
    assert got == want([tuple(r) for r in docs.select("doc_id", "text").collect()])
    small = token_files.write(make(odd), bpe, 1, shard_bytes=20_000)  # many shards
    assert small.count() > 3
    got = sorted((tuple(r) for r in token_files.read(spark, small).collect()), key=key)
    assert got == want([(r[0], r[1]) for r in odd])
    none = token_files.write(make(odd).limit(0), bpe, 1)
    assert none.count() == 0 and token_files.read(spark, none).count() == 0


# chat


CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/END]", "<", "[", "\\", "/", " ", "a", "\n", "<\\", "s>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), st.lists(st.sampled_from(CONTROLS), max_size=4).map("".join)), st.lists(st.sampled_from(CONTROLS), max_size=8).map("".join)), max_size=5))
def test_every_turn_comes_back(turns):
    text = "".join(chat_format.render(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat_format.parse(text)] == turns
    for _, t in turns:
        assert chat_format.unescape(chat_format.escape(t)) == t


def test_plain_turns_stay_as_they_are():
    assert chat_format.render("user", "hi")[0] == "[INST] hi [/INST]" and chat_format.render("assistant", "yo")[0] == "<s>yo</s>"
    for bad in ("hi", "[INST] hi", "<s>a[/INST]", "[ROLE]x"):
        with pytest.raises(ValueError):
            chat_format.parse(bad)


def test_conversations(spark):
    rows = [(1, 0, "system", "be</s>"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] ok"), (1, 3, "assistant", "two"), (2, 0, None, "x"), (2, 0, "tool", "[/ROLE]"), (2, 0, "tool", "[/ROLE]"), (None, 1, "user", "lone"), (3, None, "assistant", "é🙂" * 50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))

    def digest(turns):
        own = [(r or "", t or "") for r, t in turns]
        loss = "".join(t for r, t in own if r == "assistant")
        return len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()

    want = {1: [r[2:] for r in rows[:4]], 2: [r[2:] for r in rows[4:7]], None: [rows[7][2:]], 3: [rows[8][2:]]}
    for limit in (chat_format.PART, 10):  # whole, and in parts
        formatted = chat_format.format_conversations(df, limit)
        assert {r.conv_id: tuple(r)[1:5] for r in chat_format.read_back(formatted).collect()} == {k: digest(v) for k, v in want.items()}
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


# SentencePiece


def best(pieces, text):
    """The highest score of any segmentation."""
    marked = sentencepiece_viterbi.SPACE + sentencepiece_viterbi.mark(text) if text else ""
    units, k = [], 0
    while k < len(marked):
        units.append((marked[k + 1], True) if marked[k] == "\0" else (marked[k], False))
        k += 1 + (marked[k] == "\0")
    score = [0.0] + [-math.inf] * len(units)
    for end in range(1, len(units) + 1):
        c, literal = units[end - 1]
        one = None if literal else pieces.root[0].get(c)
        if one is None or one[1] is None:
            score[end] = score[end - 1] + pieces.byte_score * len(c.encode())
        for start in range(max(0, end - pieces.longest), end):
            node = pieces.root
            for c, literal in units[start:end]:
                node = node and not literal and node[0].get(c)
            if node and node[1] is not None:
                score[end] = max(score[end], score[start] + node[1])
    return score[-1]


def cost(pieces, ids):
    found = {}

    def walk(node):
        if node[1] is not None:
            found[node[2]] = node[1]
        for child in node[0].values():
            walk(child)

    walk(pieces.root)
    return sum(found.get(i, pieces.byte_score) for i in ids)


def test_stream_finds_the_best_path(pieces):
    own, rng = sentencepiece_viterbi.Pieces(pieces), random.Random(3)
    for n in [0, 1, 2, 5, 30, 200] * 8:
        text = "".join(rng.choice("abcdeth ring▁\0 éß漢字\n🙂ly,.") for _ in range(n))
        ids = own.encode(text)
        assert own.decode(np.array(ids)).decode() == text
        assert cost(own, ids) == pytest.approx(best(own, text))


def test_runs_of_spaces_take_the_best_path_over_all_pieces(pieces):
    """Against all pieces of the file, not those that the search has kept; also through the memory of words."""
    import sentencepiece

    own, model = sentencepiece_viterbi.Coder(pieces), sentencepiece.SentencePieceProcessor(model_file=pieces)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    score = {model.id_to_piece(i): -math.log(-model.get_score(i) + sentencepiece_viterbi.RANK_OFFSET) for i in usable}
    by_id = {i: score[model.id_to_piece(i)] for i in usable}
    assert sum(len(p) > 1 and not p.strip(sentencepiece_viterbi.SPACE) for p in score) == 14
    longest = max(map(len, score))

    def highest(text):
        marked = (sentencepiece_viterbi.SPACE + text.replace(" ", sentencepiece_viterbi.SPACE)) if text else ""
        at = [0.0] + [-math.inf] * len(marked)
        for end in range(1, len(marked) + 1):
            if marked[end - 1] not in score:
                at[end] = at[end - 1] + own.pieces.byte_score * len(marked[end - 1].encode())
            at[end] = max([at[end], *(at[k] + score[marked[k:end]] for k in range(max(0, end - longest), end) if marked[k:end] in score)])
        return at[-1]

    rng = random.Random(16)
    texts = [" ", "  ", "a  b", "def f():\n        return 1\n    pass", "  x", "x   ", "", None, "a b", "é" + " " * 40 + "\t", "x" + " " * 5000 + "y", "\n" + " " * 16]
    texts += ["".join(rng.choice(["the", "a", "\n", "é", " ", "  ", " " * rng.randrange(1, 40)]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    for _ in range(2):  # new, and remembered
        ids, ends = own.encode(pa.array(texts))
        for k, text in enumerate(texts):
            got = ids[ends[k] : ends[k + 1]]
            assert own.pieces.decode(got).decode() == (text or "")
            assert sum(by_id.get(int(i), own.pieces.byte_score) for i in got) == pytest.approx(highest(text or ""))
            assert got.tolist() == own.pieces.encode(text or "")
    assert len(own.pieces.encode(" " * 15)) == 1


def test_stream_is_the_same_in_any_blocks(pieces):
    own = sentencepiece_viterbi.Pieces(pieces)
    text = "▁the" * 300 + "a" * 2000 + "therethe" * 300
    assert list(own.stream(iter(text))) == list(own.stream([text])) == list(own.stream([text[:1777], "", text[1777:]]))


def test_sentencepiece_of_odd_rows(spark, sf_dir, make, odd, pieces):
    got = sentencepiece_viterbi.encode(make(odd), pieces).collect()
    assert sorted((r.decoded for r in got)) == sorted(r[1] or "" for r in odd)
    own = sentencepiece_viterbi.Pieces(pieces)
    assert all(r.ids == own.encode(r.decoded) for r in got if len(r.decoded) < 1000)
    short = sentencepiece_viterbi.digests(make(odd), pieces).collect()
    assert all(r.exact for r in short) and {r.n_ids for r in short if r.doc_id in (0, 1)} == {0}
    assert sentencepiece_viterbi.encode(make(odd).limit(0), pieces).count() == 0
    assert op8_sentencepiece(spark, sf_dir).where("NOT exact").count() == 0
