"""What the tests of the corpus operators share; fixtures are imported by name."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, key long, row long, n long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies, and columns with clashing names."""
    rng = random.Random(11)
    words = [f"w{k}é" for k in range(60)] + ["it's", "a", "\t", "12", "..."]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 12, 40]))) for _ in range(40)]
    texts += [None, "", "  \n ", "x" * 3000, "ab " * 2000, "<|endoftext|> a  b\n\n c", "日本語 テスト", "\x00 \x1c\x85 y"]
    texts += texts[:8] + [None, ""] + [texts[5]] * 6
    rows = [(i * 5, t, "en", "s", None if t is None else len(t), 1, 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "null id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(frame):
    """doc_id and text of every row, null text as empty."""
    return [(x.doc_id, x.text or "") for x in frame.select("doc_id", "text").collect()]
