"""Rules, dedup, classifier, decontamination, URLs and the pipeline: against brute force."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from columnforge.llm import _filter, _shared, decontaminate, kneser_ney, line_dedup, near_dedup, quality_rules, url_filter
from columnforge.llm.queries import RULES, op6_quality_classifier, op10_url_filter, table

from .conftest import words

TOKEN = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# quality rules


def base_of(text):
    w = TOKEN.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if TOKEN.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)


def test_base_rules(make, odd):
    rng = random.Random(2)
    texts = [words(rng, n, "ab") + "\n" + words(rng, n, "abc") + "\n#a<b>\n#a<b>" for n in (1, 3, 20, 60)] + ["a b c a b c a b c", "a b", "\n\n", "a\nb\na", "x y z " * 50]
    rows = [r for r in odd if r[0] != 3] + [(100 + k, t, "en", "z") for k, t in enumerate(texts)]
    got = sorted(((r.doc_id is None, r.doc_id or 0), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality_rules.base(make(rows)).collect())
    assert got == sorted(((r[0] is None, r[0] or 0), base_of(r[1])) for r in rows)
    assert quality_rules.base(make(odd)).where("doc_id = 3").first().n_words == 30_000


def test_hosts(make):
    rng = random.Random(3)
    good, bad = words(rng, 80), "short"
    rows = [(k, bad if k % 10 else good, "en", "spam") for k in range(60)] + [(100 + k, good if k % 10 else bad, "en", "fine") for k in range(60)] + [(300, bad, "en", "new"), (301, good, "en", None), (302, good, "en", "new")]
    got = {r.doc_id: r for r in quality_rules.rules(make(rows)).collect()}
    assert not got[0].kept and not got[0].base_failed and got[0].host_rate > 0.7  # a good page of a bad host
    assert got[101].kept and not got[100].kept and got[101].host_rate < 0.3
    assert got[301].kept and got[301].host_rate is None and got[302].kept and 0.3 < got[302].host_rate < 0.7  # shrunk
    assert quality_rules.rules(make(rows).limit(0)).count() == 0
    assert quality_rules.prior(0, 0, 0) == quality_rules.prior(5, 5, 5) == (1.0, 1.0)


# near-dedup


def brute_components(rows, percent=75):
    sets = []
    for doc_id, text in rows:
        w = TOKEN.findall((text or "").translate(LOWER))
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        n = len(x & y)
        if x and y and 100 * n >= percent * (len(x) + len(y) - n):
            up[max(top(a), top(b))] = min(top(a), top(b))
    return {(d, len(s), top(d)) for d, s in sets}


def family(rng, n, size, rate):
    first = words(rng, size).split(" ")
    for _ in range(n):
        yield " ".join(words(rng, 1) if rng.random() < rate else w for w in first)


def test_near_copies_equal_brute_force(make, monkeypatch):
    """Families around the threshold, with pairs below it, in blocks of a few rows."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    rng = random.Random(4)
    texts = [t for k in range(4) for t in family(rng, 40, 60 + 40 * k, 0.01 * (k + 1))] + ["one two", "one two", "One  two", "a b c d", "", None] + [words(rng, 50)] * 5
    rng.shuffle(texts)
    got = near_dedup.duplicates(make(texts)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(list(enumerate(texts)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


def test_near_dedup_of_odd_rows(make, odd):
    got = near_dedup.duplicates(make(odd)).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: (r.component_id, r.kept) for r in got}
    assert by[0] == (0, True) and by[1] == (1, True) and by[4] == (4, True) and by[5] == (4, False) and by[None] == (None, True)
    assert near_dedup.duplicates(make(odd).limit(0)).count() == 0
    both = near_dedup.duplicates(make([(1, "a b c d e f", "en", "s"), (1, "g h i j k l", "en", "s"), (2, "g h i j k l", "en", "s"), (3, "a b c d e f", "en", "s")])).collect()
    assert {(r.doc_id, r.component_id) for r in both} == {(1, 1), (2, 1), (3, 1)}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for n in (3, 40, 3000):
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        more = rng.integers(0, 1 << 63, 2 * (n // 3), dtype=np.uint64).reshape(2, -1)
        sets = [np.concatenate((common, m)) for m in more]
        sk = near_dedup.sketches(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        assert (sk != np.iinfo(np.uint64).max).all()
        assert abs((sk[0] == sk[1]).mean() - n / (n + 2 * (n // 3))) < 0.2


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 90), (90, 80), (5, 5)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[k] == 1 for k in range(1, 61)) and got[100] == got[90] == got[80] == 80


# line dedup


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute_lines(rows):
    """(n_lines, recurring, dropped) of each row (id, text), by the tree's definition: leaves, groups in order of the templates' hashes."""
    found, seen = [], {}
    for k, (doc_id, text) in enumerate(rows):
        key = (doc_id is None, text) if doc_id is None else (False, doc_id)
        for line in (text or "").split("\n"):
            raw = TOKEN.findall(line)
            if raw:
                tok = ["<*>" if re.search("[0-9]", x) else x for x in raw]
                tok = tuple(raw if set(tok) == {"<*>"} else tok)
                found.append((k, key, tok))
                seen.setdefault(tok, set()).add(key)
    leaves, into = {}, {}
    for tok in seen:
        leaves.setdefault((len(tok), tok[:3]) if len(tok) >= 6 else tok, []).append(tok)
    for group in leaves.values():
        seeds = []
        for tok in sorted(group, key=lambda t: hashlib.md5(" ".join(t).encode()).hexdigest()[:15]):
            into[tok] = next((s for s in seeds if 100 * sum(x == y for x, y in zip(s, tok, strict=True)) >= 75 * len(tok)), tok)
            if into[tok] == tok:
                seeds.append(tok)
    docs = {}
    for tok, keys in seen.items():
        docs.setdefault(into[tok], set()).update(keys)
    out = [[len(t.split("\n")) if t is not None else 0, 0, 0] for _, t in rows]
    for k, key, tok in found:
        if len(own := docs[into[tok]]) > 1:
            named = [x for x in own if not x[0]]
            out[k][1] += 1
            out[k][2] += (min(named) if named else min(own, key=lambda x: signed(x[1]))) != key
    return [tuple(x) for x in out]


def check_lines(make, rows):
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_lines, r.n_recurring, r.n_dropped) for r in line_dedup.summary(make([(d, t, "en", "s") for d, t in rows])).collect())
    assert got == sorted(((d is None, d or 0), *x) for (d, _), x in zip(rows, brute_lines(rows), strict=True))


def test_lines(make):
    rng = random.Random(6)
    note, log = "this work is licensed to all of you", "worker {} took {} ms on host h{}x now"
    bodies = ["\n".join(words(rng, 12) for _ in range(4)) for _ in range(8)]
    texts = [b + "\n" + note for b in bodies[:4]] + [b + "\n" + log.format(k, k * 7, k) for k, b in enumerate(bodies[4:7])] + [bodies[7], bodies[7], "short line\nshort line", "short line\n12 30\n12 31", "12 32", None, ""]
    docs = make(texts)
    got = {r.doc_id: r.n_dropped for r in line_dedup.summary(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1, 7: 0, 8: 4, 9: 0, 10: 1, 11: 0, 12: 0, 13: 0}
    clean = {r.doc_id: r for r in line_dedup.clean(docs).collect()}
    assert clean[1].text == bodies[1] and clean[0].text == texts[0] and clean[8].text == bodies[7] and clean[12].text is None and clean[1].kept == "x"
    assert clean[10].text == "12 30\n12 31"  # numbers alone are data
    assert line_dedup.clean(docs).columns == docs.columns


@pytest.mark.parametrize("small", [line_dedup.SMALL, 1])
def test_lines_equal_brute_force(make, monkeypatch, small):
    """With leaves as one row each, and all in rounds. Families around the limit of agreement, several in a leaf, some in one document only; ids with several texts, null ids, repeated rows."""
    monkeypatch.setattr(line_dedup, "SMALL", small)
    rng = random.Random(16)
    rows = []
    for k in range(60):
        own = []
        for _ in range(12):
            fam = rng.randrange(4)
            line = f"one two three f{'abcd'[fam]} " + " ".join("qrstuvwxyz"[fam + j % 5] * (1 + j % 2) for j in range(rng.choice((3, 8, 12))))
            tok = line.split()
            for _ in range(rng.randrange(5)):
                tok[rng.randrange(3, len(tok))] = rng.choice(("u", "v", "w8", "x", "y"))
            own.append(" ".join(tok))
        rows.append((k % 50 if k % 7 else None, "\n".join([*own, rng.choice(("ok", "end of page", "4 5"))])))
    check_lines(make, [*rows, rows[3], (None, rows[7][1]), (None, "a b c d e f g\na b c d e f h"), (None, "a b c d e f i")])


def test_groups_of_a_leaf(make):
    """Lines that agree share a group, though no digit marks the difference, whatever else is in the leaf."""
    rng = random.Random(7)
    tail = lambda *names: [(k, words(rng, 30) + "\n" + n) for k, n in enumerate(names)]
    count = lambda rows: [r.n_dropped for r in line_dedup.summary(make([(d, t, "en", "s") for d, t in rows])).orderBy("doc_id").collect()]
    assert sum(count(tail(*(f"user {n} logged in from the office today" for n in ("ann", "bob", "cyd", "ann"))))) == 1  # the name is a leading token
    assert count(tail(*(f"the user called {n} logged in from the office today" for n in ("ann", "bob", "cyd", "ann")))) == [0, 1, 1, 1]
    assert sum(count(tail("one two three four five six", "one two three x y z"))) == 0
    two = [f"a b c {x} red green blue pink {n}" for x, n in (("k", "ann"), ("k", "bob"))] + [f"a b c {x} up down left right {n}" for x, n in (("l", "cyd"), ("l", "dan"))]
    assert count(tail(*two)) == [0, 1, 0, 1]
    alone = [(0, words(rng, 30) + "\none two three four five six seven ann\none two three four five six seven bob"), (1, words(rng, 30))]
    assert [(r.n_recurring, r.n_dropped) for r in line_dedup.summary(make([(d, t, "en", "s") for d, t in alone])).collect()] == [(0, 0), (0, 0)]


def test_many_variants_of_a_line(make):
    """One family of many templates: rounds over buckets, no pairs of them all."""
    rows = [(k, f"one two three four five {words(random.Random(k), 1, 'abcdefghijklm')}x{'qrstuvw'[k % 7]} six seven eight nine") for k in range(400)]
    check_lines(make, rows)


def test_large_leaves(make, monkeypatch):
    """A large family is compared with a row of seeds; buckets are for what has many groups in a leaf."""
    names, whole = [], line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, name: names.append(name) or whole(df, name))
    family = [(k, f"one two three four five {words(random.Random(k), 1, 'abcdefghijklm')}x{'qrstuvw'[k % 7]} six seven eight nine") for k in range(200)]
    check_lines(make, family)
    assert "compared" in names and "buckets" not in names
    monkeypatch.setattr(line_dedup, "SMALL", 4)
    rng = random.Random(8)
    alone = [f"one two three {words(rng, 8)}" for _ in range(30)]
    many = [(300 + k, x) for k, x in enumerate([*alone, *(x.rpartition(" ")[0] + " end" for x in alone[::3])])]
    check_lines(make, many + family[:20])
    assert "buckets" in names


def test_many_groups_of_a_leaf(make, monkeypatch):
    """Lines that share tokens and do not agree: a few rounds, not one for each of their groups."""
    names, whole = [], line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, name: names.append(name) or whole(df, name))
    rng = random.Random(10)
    rows = [(k, f"one two three four {'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]} {words(rng, 1, 'qrstuvw')}y") for k in range(100)]
    check_lines(make, rows + [(200 + k, t) for k, (_, t) in enumerate(rows[::4])])
    assert "buckets" not in names and names.count("compared") == 1


def test_tokens_of_wanted_lines_only(make, monkeypatch):
    """All lines are written without their tokens, which are read again for those of leaves with several templates."""
    sent, whole = {}, line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, name: sent.setdefault(name, whole(df, name)))
    rng = random.Random(11)
    rows = [(k, words(rng, 12) + "\n" + f"all the users called {n} logged in today from home") for k, n in enumerate(("ann", "bob", "cyd", "dan"))]
    check_lines(make, [*rows, (None, rows[0][1]), (9, rows[1][1] + "\n1 2")])
    assert "tokens" not in sent["lines"].columns and 0 < sent["tokens"].where("tokens IS NOT NULL").count() < sent["lines"].count() / 2


def test_shares_of_repeated_rows(make, monkeypatch):
    """Words of a text are summed up from its lines, and both grow alike when a row is repeated."""
    sent, whole = {}, line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, name: sent.setdefault(name, whole(df, name)))
    note, rng = "this line is in some of them all", random.Random(14)
    rows = [(k, words(rng, 12) + "\n\t\n " + words(rng, 9) + "  5 \n" + note, "en", "s") for k in (0, 1, 1, None)]
    rows[2] = rows[1]
    assert line_dedup.drops(make(rows)).count() == 2
    assert sorted(((r.doc_id is None, r.n / r.words) for r in sent["shares"].collect())) == [(False, 8 / 30), (True, 8 / 30)]


def test_texts_that_lose_nothing_do_not_move(spark, make, monkeypatch):
    """A filter parts them from the others, and finds every key, null ones too."""
    keys = _shared.stage(spark.createDataFrame([(k * 100, k) for k in range(50)] + [(None, 7)], "a long, b long"), "keys")
    rows = spark.createDataFrame([(k, b) for k in [*range(0, 5000, 25), None] for b in (k // 100 if k else 0, 7)], "a long, b long")
    got = [(r.a, r.b, r.may) for r in _filter.Filter(keys, "a", "b").marked(rows, "may", "a", "b").collect()]
    there = {tuple(r) for r in keys.collect()}
    assert sorted(map(repr, got)) == sorted(repr((r.a, r.b, ((r.a, r.b) in there) or m)) for r, m in zip(rows.collect(), [x[2] for x in got], strict=True))
    assert sum(m for *_, m in got) < 0.5 * len(got)
    sent, marked = [], _filter.Filter.marked
    monkeypatch.setattr(_filter.Filter, "marked", lambda *x: sent.append(_shared.stage(marked(*x), "marked")) or sent[-1])
    note, rng = "this line is in some of them all", random.Random(9)
    texts = [words(rng, 20) + ("\n" + note) * (k < 3) for k in range(60)]
    assert [r.text for r in line_dedup.clean(make(texts)).orderBy("doc_id").collect()] == [texts[0], *(t.split("\n")[0] for t in texts[1:])]
    assert 2 <= sent[0].where("_may").count() < 30


def test_lines_of_odd_rows(make, odd):
    docs = make(odd)
    assert line_dedup.summary(docs).count() == len(odd)
    check_lines(make, [(r[0], r[1]) for r in odd])
    assert sorted(str(r.text) for r in line_dedup.clean(docs).collect()) == sorted(str(r[1]) for r in odd)
    for df in (line_dedup.summary(docs.limit(0)), line_dedup.clean(docs.limit(0))):
        assert df.count() == 0
    passage = "a passage of many words that recurs as the only line"
    left = line_dedup.clean(make([words(random.Random(1), 40) + "\n" + words(random.Random(2), 40) + "\n" + passage, words(random.Random(3), 40) + "\n" + passage]), drop_empty=True)
    assert left.count() == 2


def test_only_verified_copies_keep_lines(make):
    """Half of the words from one document make no copy; a copy loses what it has from other documents."""
    rng = random.Random(12)
    passage, note = words(rng, 60), "this work is licensed to all of you"
    body = [words(rng, 12) for _ in range(40)]
    changed = [*body[:39], words(rng, 12)]
    texts = [note + "\n" + words(rng, 40), words(rng, 40) + "\n" + passage, words(rng, 40) + "\n" + passage, "\n".join([*body, note]), "\n".join([*changed, note]), "\n".join([*body, note])]
    left = {r.doc_id: r.text for r in line_dedup.clean(make(texts)).collect()}
    assert left[0] == texts[0] and left[1] == texts[1]
    assert left[2] == texts[2].split("\n")[0]  # a Jaccard of 0.43: neither stage would have dropped it
    assert (left[3], left[4], left[5]) == ("\n".join(body), "\n".join(changed), "\n".join(body))
    assert {r.component_id for r in near_dedup.duplicates(line_dedup.clean(make(texts))).where("doc_id > 2").collect()} == {3}


def test_copies_that_near_dedup_would_not_find_lose_lines(make):
    """What decides is what is left of both: here most of what two documents share comes from a third."""
    rng = random.Random(13)
    shared, own, rest = words(rng, 120), words(rng, 150), [words(rng, n) for n in (100, 30, 30)]
    texts = [shared + "\n" + rest[0], "\n".join([shared, own, rest[1]]), "\n".join([shared, own, rest[2]])]
    assert {c for d, _, c in brute_components(list(enumerate(texts))) if d == 2} == {1}
    left = {r.doc_id: r.text for r in line_dedup.clean(make(texts)).collect()}
    assert left == {0: texts[0], 1: own + "\n" + rest[1], 2: rest[2]}


# Kneser-Ney


def brute_model(texts, symbols):
    """-ln p of texts under the interpolated model of some texts, by dictionaries; `symbols` is one more than the characters known."""
    grams = {}
    for t in texts:
        s = [None] * 3 + list(t)
        for k in range(3, len(s)):
            g = tuple(s[k - 3 : k + 1])
            grams[g] = grams.get(g, 0) + 1
    orders = [grams]
    while len(orders) < 4:
        lower = {}
        for g in orders[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        orders.append(lower)
    orders.reverse()
    stats = []
    for counts in orders:
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], kneser_ney.LEAST), float(k)) if n[k - 1] and n[k] else min(0.5 * k, 1.0) for k in (1, 2, 3)]
        total, held = {}, {}
        for g, c in counts.items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            held[g[:-1]] = held.get(g[:-1], 0) + d[min(c, 3) - 1]
        stats.append((counts, d, total, held))

    def p(gram):
        out = 1 / symbols
        for k, (counts, d, total, held) in enumerate(stats, 1):
            g = gram[-k:]
            if g[:-1] in total:
                c = counts.get(g, 0)
                out = (max(c - d[min(c, 3) - 1], 0) if c else 0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * out
        return out

    def nll(text):
        s = [None] * 3 + list(text)
        return -sum(math.log(p(tuple(s[k - 3 : k + 1]))) for k in range(3, len(s)))

    return nll


def brute_scores(train, tried):
    """Of each tried text -ln p by the model of the half of the training texts that it is not in."""
    symbols = len(set("".join(train))) + 1
    halves = [[t for t in train if signed(t) % 2 == h] for h in (0, 1)]
    models = [brute_model(h if all(halves) else train, symbols) for h in halves]
    return [models[1 - signed(t) % 2](t) if t else 0.0 for t in tried]


def test_perplexity_equals_brute_force(spark, make, monkeypatch):
    """Many scripts, short steps, several blocks; a text longer than a step."""
    monkeypatch.setattr(kneser_ney, "STEP", 50)
    monkeypatch.setattr(kneser_ney, "HELD", 200)
    monkeypatch.setattr(kneser_ney, "BLOCK_ROWS", 7)
    rng = random.Random(8)
    texts = [words(rng, 60, a) for a in ("abcde", "абвгде", "αβγδ", "कखगघ", "漢字仮名交文") for _ in range(8)] + ["é🙂漢", "", "a", "\0\0"]
    tried = [*texts, "zzz", "abc\0 d", None, "漢漢漢z"]
    for train in (texts, ["abc"]):
        model = kneser_ney.model_of(_shared.stage(kneser_ney.counts_of(make(train)), "grams"))
        got = {r.doc_id: r for r in kneser_ney.score(make(tried), model).collect()}
        assert [got[k]._nll for k in range(len(tried))] == pytest.approx(brute_scores(train, tried), rel=1e-4, abs=1e-4)
        assert [got[k]._chars for k in range(len(tried))] == [len(t or "") for t in tried]
    assert kneser_ney.model_of(_shared.stage(kneser_ney.counts_of(make([])), "grams")) is None


def test_verdicts_equal_brute_force(spark, make):
    """Means, quantiles, thresholds and what is kept, for two languages and one without trusted text."""
    rng = random.Random(18)
    rows = [(k, words(rng, rng.randrange(2, 40), "abcdef" if k % 3 else "uvwxyz"), ("en", None, "de", "xx")[k % 3 if k < 110 else 3], "s") for k in range(120)]
    rows += [(200, "".join(rng.choice("qjk#%&") for _ in range(300)), "en", "s"), (201, "", "en", "s")]
    labels = [(k, int(k % 5 > 0), int(k % 7 == 0)) for k in range(0, 110)] + [(3, 0, 0)]
    good = {k for k, q, t in labels if q and not t} - {3}
    scores = brute_scores([t for d, t, *_ in rows if d in good], [t for _, t, *_ in rows])
    by = {}
    for (d, t, lang, _), nll in zip(rows, scores, strict=True):
        if d in good and t:
            by.setdefault(lang, []).append((nll, len(t)))
    mean = {k: sum(a for a, _ in v) / sum(n for _, n in v) for k, v in by.items()}
    drawn = lambda nll, n, m: (nll + kneser_ney.PSEUDO * m) / (n + kneser_ney.PSEUDO)
    low = lambda v: sorted(v)[max(0, math.ceil(kneser_ney.QUANTILE * len(v)) - 1)]
    over = {k: [drawn(a, n, mean[k]) - mean[k] for a, n in v] for k, v in by.items()}
    whole = low([x for v in over.values() for x in v])
    cut = {k: math.exp(mean[k] + (len(v) * low(v) + kneser_ney.SHRINK * whole) / (len(v) + kneser_ney.SHRINK)) * kneser_ney.MARGIN for k, v in over.items()}
    got = {r.doc_id: r for r in kneser_ney.classify(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select("doc_id", "perplexity", "threshold", kneser_ney.F.col("drawn")).collect()}
    for (d, t, lang, _), nll in zip(rows, scores, strict=True):
        assert got[d].threshold == (pytest.approx(cut[lang], rel=1e-3) if lang in cut else None)
        assert got[d].perplexity == (pytest.approx(math.exp(nll / len(t)), rel=1e-3) if t else None)
    kept = {r.doc_id for r in kneser_ney.accepted(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    clear = {d: math.exp(drawn(nll, len(t), mean[lang])) / cut[lang] for (d, t, lang, _), nll in zip(rows, scores, strict=True) if t and lang in cut}
    assert all((d in kept) == (clear.get(d, 0) <= 1) for d, *_ in rows if abs(clear.get(d, 0) - 1) > 1e-3) and 200 not in kept and len(kept) > 100


def test_classifier(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    got = {r.doc_id: r for r in op6_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    marks = labels.collect()
    good = [got[r.doc_id].kept for r in marks if r.quality == 1 and r.toxic == 0]
    poor = [got[r.doc_id].kept for r in marks if r.quality == 0]
    assert len(got) == docs.count() and np.mean(good) > 0.98 and np.mean(poor) < 0.15


def test_classifier_of_odd_rows(spark, make, odd):
    docs = make(odd)
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (3, 1, 0), (6, None, None), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(docs, labels)
    assert got.count() == len(odd) and got.columns[: len(docs.columns)] == docs.columns
    assert all(r[-1] for r in got.collect() if not r.text)
    for empty in (labels.limit(0), labels.where("doc_id = 99")):
        assert all(r[-1] for r in kneser_ney.classify(docs, empty).collect())
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0


def test_languages_without_trusted_text_are_kept(spark, make):
    """No language is judged by the level of another, be it rare, unlabelled or without labels."""
    rng = random.Random(14)
    rows = [(k, words(rng, 40), "en", "s") for k in range(60)] + [(100 + k, words(rng, 40, "qrstuvwxyz"), lang, "s") for k, lang in enumerate(("xx", None, "xx"))]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(make(rows), labels).collect()}
    assert all(got[k].kept and got[k].threshold is None and got[k].perplexity > got[0].threshold for k in (100, 101, 102))
    more = labels.unionAll(spark.createDataFrame([(100, 1, 0)], labels.schema))
    got = {r.doc_id: r for r in kneser_ney.classify(make(rows), more).collect()}
    assert got[102].kept and got[102].threshold is not None


def test_one_more_label_moves_a_threshold_little(spark):
    rng = random.Random(15)
    rows = [("en", 1000 * rng.gauss(2, 0.1), 1000) for _ in range(500)] + [("de", 1000 * rng.gauss(3, 0.1), 1000) for _ in range(30)]
    cut = [kneser_ney.thresholds(spark.createDataFrame(rows[: 500 + n], "lang string, _nll double, _chars long")).where("language = 'de'").first().threshold for n in (3, 19, 20, 21)]
    assert all(math.exp(3) < c < math.exp(3.5) for c in cut) and max(cut[1:]) / min(cut[1:]) < 1.05


# decontamination


def brute_hits(text, items, window=10):
    w = TERM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for name, item in items:
        own = TERM.findall((item or "").translate(LOWER))
        m = min(window, len(own))
        wins = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 300])
def test_contamination_equals_brute_force(spark, make, odd, block_bytes):
    rng = random.Random(9)
    items = [(k, words(rng, n, "abc")) for k, n in enumerate((25, 12, 10, 9, 3, 1, 30))] + [(7, None), (8, "..."), (9, "a b"), (10, "A-B")]
    body = lambda: words(rng, 30, "abc")
    texts = [f"{body()} {t} {body()}" for _, t in items[:7]] + [body() for _ in range(5)] + [items[0][1][:60], items[0][1] + " " + items[0][1], items[3][1], "x " * 10 + "B. a, B"]
    rows = list(enumerate(texts, 50)) + [(r[0], r[1]) for r in odd if r[0] is not None]
    docs = make([(d, t, "en", "s") for d, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()
    want = sorted((d, *brute_hits(t, items)) for d, t in rows)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def brute_near(text, items, span, window=10):
    w = TERM.findall((text or "").translate(LOWER))
    found = set()
    for name, item in items:
        own = TERM.findall((item or "").translate(LOWER))
        m = min(window, len(own))
        wins = {frozenset(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
        if name is not None and any(x <= set(w[i : i + span]) for x in wins for i in range(len(w))):
            found.add(str(name))
    return sorted(found)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 40])
def test_proximity(spark, make, monkeypatch, block_bytes):
    """All words of a window, in any order, within a span of one document; several shards and small blocks of candidates."""
    monkeypatch.setattr(decontaminate, "SHARD", 300)
    monkeypatch.setattr(decontaminate, "LIMIT", 64)
    rng = random.Random(10)
    texts = [words(rng, 60, "abcd") for _ in range(30)] + ["x y", "z x", "", None]
    items = [("p", "a b c"), ("q", "aa b"), ("r", "d"), ("s", "a a b"), (None, "c"), ("t", "x y z"), ("u", "a b c d aa bb cc dd ab ba da")]
    got = decontaminate.contamination(make(texts), spark.createDataFrame(items, "item_id string, text string"), span=6, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.near, r["items"]) for r in got} == {k: (brute_near(t, items, 6), [x for x in brute_hits(t, items)[2] if x != "None"]) for k, t in enumerate(texts)}


def test_memory_of_test_items():
    """The arrays of 32 MB of test items need less than 500 MB."""
    rng = np.random.default_rng(3)
    lexicon = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(50_000)], object)
    texts = [" ".join(lexicon[rng.integers(0, len(lexicon), 60)]) for _ in range(90_000)]
    items = pa.table({"i": pa.array([str(k) for k in range(len(texts))]), "t": pa.array(texts)})
    assert items["t"].nbytes > 31e6
    tracemalloc.start()
    phrases = decontaminate.Phrases(items, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and sum(len(g[1]) for g in phrases.groups) > 4_000_000


def test_clean_of_rows_without_ids(spark, make):
    """A contaminated row goes whether it has an id or not; others of equal id stay."""
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"a {item} b", "en", "s"), (None, "quite another text", "en", "s"), (5, f"{item}", "en", "s"), (5, "kept with the same id", "en", "s"), (6, None, "en", "s")]
    left = decontaminate.clean(make(rows), bench)
    assert left.columns == make(rows).columns
    assert sorted(str(r.text) for r in left.collect()) == ["None", "kept with the same id", "quite another text"]


# URLs


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def ruled(host, path):
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_rules(spark):
    urls = ["http://Example.com/en/1", "https://www.example.com/en/2?x=/fr/", "http://a.www.example.com/en", "http://b.net/es/q", "http://b.net/fr", "http://net/fr/", "http://x.org/en/?a=1&b=2#c", "http://notcom/", "no scheme", None, "http://", "http://c.com", "ftp://x.com?y", "a://b.net/es/://c.com/", "HTTP://É.NET/fr/\n"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("x"))
    for r in url_filter.judge(rows, RULES).collect():
        host, path = split(urls[r.page_id])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (r.score is None) == (rule is not None)
        assert r.verdict == (verdict or ("block" if r.score > 0.5 else "allow"))
    assert url_filter.judge(rows.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(rows, []).collect()} == {"allow"}


def test_rules_of_equal_length(spark):
    """The longer host wins; of the same rule with two verdicts, one is taken whatever their order."""
    rows = spark.createDataFrame([(1, "http://a.bc/de")], "page_id long, url string")
    rules = [("block", "a.bc/d"), ("allow", "bc/de")]
    for given in (rules, rules[::-1], [*rules, ("allow", "a.bc/d")], [("allow", "a.bc/d"), *rules]):
        (r,) = url_filter.judge(rows, given).collect()
        assert (r.rule, r.verdict) == ("a.bc/d", "block")


def brute_features(url, rates):
    host, path = split(url)
    data = (url or "").encode()
    share = [data.count(bytes([b])) / len(data) for b in set(data)] if data else []
    query = (url or "").partition("?")[2].partition("#")[0]
    digits = sum(48 <= b <= 57 for b in data) / max(1, len(data))
    return [len(data), len(host), len(path), path.count("/"), digits, round(-sum(p * math.log2(p) for p in share), 9), len([x for x in query.split("&") if x]), host.count("-"), host.count(".") + bool(host), *rates]


def brute_trees(x, y, trees, depth, bins, rate):
    """Boosting with each split searched over all bins' edges by plain sums; margins of x."""
    p0 = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    base = math.log(p0 / (1 - p0))
    edges = [sorted(set(np.quantile([r[j] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(len(x[0]))]
    margin = [base] * len(y)
    for _ in range(trees):
        g = [1 / (1 + math.exp(-m)) for m in margin]
        h = [p * (1 - p) for p in g]
        g = [p - t for p, t in zip(g, y, strict=True)]

        def grow(rows, level, g=g, h=h):
            part = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + 1)
            if level == depth:
                value = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
                for i in rows:
                    margin[i] += value
                return
            best, cut = 1e-6, None
            for j, es in enumerate(edges):
                gains = [part([i for i in rows if x[i][j] <= e]) + part([i for i in rows if x[i][j] > e]) - part(rows) for e in es] if rows else []
                if gains and max(gains) > best + 1e-12:
                    best, cut = max(gains), (j, es[gains.index(max(gains))])
            for side in (False, True):
                grow([i for i in rows if ((x[i][cut[0]] > cut[1]) if cut else False) == side], level + 1)

        grow(list(range(len(y))), 0)
    return margin


def test_trees_equal_brute_force():
    rng = random.Random(20)
    x = [[rng.random() * (1 + j) for j in range(3)] for _ in range(150)]
    y = [float((r[0] > 0.5) ^ (r[2] > 1.4) if rng.random() < 0.9 else rng.random() < 0.5) for r in x]
    model = url_filter.fit_trees(np.array(x), np.array(y), trees=4, depth=3, bins=8, rate=0.3)
    assert model.margin(np.array(x)) == pytest.approx(brute_trees(x, y, 4, 3, 8, 0.3), abs=1e-9)
    assert (url_filter.fit_trees(np.array(x), np.ones(150)).margin(np.array(x)) > 0).all()


def test_query_of_urls_equals_brute_force(spark):
    """Features, suffix rates out of fold, the fit and the scores of the whole query, from the given table."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").collect()
    got = {r.page_id: r for r in op10_url_filter(spark, "/root/testdata/sf0.01").collect()}
    fold = lambda url: xxhash.xxh64_intdigest(b"fold", xxhash.xxh64_intdigest(url.encode(), 42)) if url is not None else xxhash.xxh64_intdigest(b"fold", 42)
    fold_of = lambda url: (v - (1 << 64) if (v := fold(url)) >> 63 else v) % url_filter.FOLDS
    marks = {r.page_id: ruled(*split(r.url)) for r in pages}
    known = [(r.page_id, split(r.url)[0].split("."), fold_of(r.url), float(marks[r.page_id][1] == "block")) for r in pages if marks[r.page_id][0]]
    mean = (sum(k[3] for k in known) + 0.5) / (len(known) + 1)

    def rates(r):
        host, own = split(r.url)[0].split("."), fold_of(r.url) if marks[r.page_id][0] else None
        out = []
        for n in (1, 2):
            ys = [y for _, h, f, y in known if h[-n:] == host[-n:] and f != own]
            out.append((sum(ys) + url_filter.SMOOTH * mean) / (len(ys) + url_filter.SMOOTH))
        return out

    order = sorted(pages, key=lambda r: (r.url is None, r.url or "", r.page_id))
    x = np.array([brute_features(r.url, rates(r)) for r in order])
    fitted = [k for k, r in enumerate(order) if marks[r.page_id][0]]
    model = url_filter.fit_trees(x[fitted], np.array([float(marks[order[k].page_id][1] == "block") for k in fitted]))
    score = 1 / (1 + np.exp(-model.margin(x)))
    assert len(got) == len(pages)
    for r, s in zip(order, score, strict=True):
        rule, verdict = marks[r.page_id]
        assert got[r.page_id].score == (None if rule else pytest.approx(s, abs=1e-6)) and got[r.page_id].verdict == (verdict or ("block" if s > 0.5 else "allow"))


# shared files and the pipeline


def test_shared_folder(spark):
    assert _shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = _shared.stage(spark.range(3), "three")
    assert df.count() == 3


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "sentencepiece"]
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, _shared.stage(step(spark, docs, sf_dir), "step")
        if name == "sentencepiece":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id: r.decoded for r in docs.collect()} == {k: v or "" for k, v in texts.items()}
            break
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "near dedup":
            assert {r.doc_id for r in docs.collect()} == {d for d, _, c in brute_components(rows) if d == c}
        if name == "decontamination":
            items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
            assert {r.doc_id for r in docs.collect()} == {d for d, t in rows if not brute_hits(t, items)[1]}
        if name == "line dedup":
            assert all(set((r.text or "").split("\n")) <= set((dict(rows)[r.doc_id] or "").split("\n")) for r in docs.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r.doc_id for r in docs.collect())


def test_stages_on_odd_rows(spark, sf_dir, make, odd):
    """Each stage on nulls, empty and long texts, repeated rows: what it keeps."""
    import corpus_pipeline

    docs, rows = make(odd), [(r[0], r[1]) for r in odd]
    steps = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    whole = sorted((str(d), str(t)) for d, t in rows)
    for name in ("quality classifier", "line dedup", "near dedup", "decontamination", "sentencepiece"):
        assert steps[name](spark, docs.limit(0), sf_dir).count() == 0
    kept = texts(steps["quality classifier"](spark, docs, sf_dir))
    assert set(kept) <= set(whole) and {(str(d), str(t)) for d, t in rows if not t} <= set(kept)
    assert texts(steps["line dedup"](spark, docs, sf_dir)) == whole  # the copies are verified, so they keep their lines for near-dedup
    near = texts(steps["near dedup"](spark, docs, sf_dir))
    assert near == sorted(set(whole) - {("5", rows[6][1])})
    assert texts(steps["decontamination"](spark, docs, sf_dir)) == whole
    assert sorted((str(r.doc_id), r.decoded) for r in steps["sentencepiece"](spark, docs, sf_dir).collect()) == sorted((str(d), t or "") for d, t in rows)


def test_rows_of_one_id(make):
    """Different texts of one id are not lost; of a repeated row one stays; the choice does not hang on the order of rows."""
    a, b, c = ("a b c d e f g h", "i j k l m n o p", "q r s t u v w x")
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (2, b, "de", "s"), (3, c, "en", "s"), (4, b, "en", "s"), (None, a, "en", "s"), (None, a, "en", "s")]
    want = None
    for order in (rows, rows[::-1]):
        got = sorted((str(r.doc_id), r.text, r.lang) for r in near_dedup.deduplicated(make(order)).collect())
        assert [x[:2] for x in got] == [("1", a), ("3", c), ("4", b), ("None", a), ("None", a)]
        want = want or got
        assert got == want
    assert near_dedup.deduplicated(make([(2, b, "en", "s"), (2, b, "de", "s"), (2, c, "en", "s")])).count() == 2
