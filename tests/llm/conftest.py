import random

import pytest

from columnforge.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int"


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (id, text, lang, source) rows, with more columns whose names clash with results."""

    def build(rows):
        full = [(k, r, "en", "s", len(r or "")) if isinstance(r, str | None) else (*r, len(r[1] or "")) for k, r in enumerate(rows)]
        return spark.createDataFrame([(*r, "x", 1) for r in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, one long text, repeated rows, null ids and labels."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    rows = [(0, None, "en", "a"), (1, "", "de", "a"), (2, " \t\n\x0b", None, "b"), (3, long, "en", None), (4, "Same text here. " * 4, "en", "b"), (4, "Same text here. " * 4, "en", "b"), (5, "Same text here. " * 4, "de", "b"), (None, "No id at all, none", "en", "c"), (6, "1 2 3 \0 ▁ é ß 漢字 🙂", "fr", "c"), (7, "x" * 5000, "en", "c")]
    return rows


@pytest.fixture(scope="session")
def pieces():
    return tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def bpe():
    return tokenizer("word_bpe_49k.json")
