from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, held_out string, media string, pattern long"


def prose(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and columns whose
    names the operators use themselves."""
    rng = random.Random(5)
    words = [a + b for a in ("the", "an", "over", "Un", "größ", "niñ") for b in ("", "er", "ing.", "o,", "ß", "ña")]
    texts = [None, "", " \t\n ", "!!! ... 123", "one", "Two words", "\x00\x1f\x7f", "a\u00a0b \u3000c", "😀 🚀", "x" * 5000, prose(rng, 30000, words)]
    texts += [prose(rng, n, words) for n in (3, 10, 60, 64, 65, 500, 500)]
    texts += ["spam " * 200, "line\nline\nline\n\nother\nline", texts[-1]]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or ""), 0.5, 7, "x", "y", 1) for i, t in enumerate(texts)]
    rows.append((None, "a row without an id", "en", "a", 1, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None))
    return rows + [rows[5], rows[5], rows[12]]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def data():
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    return "/root/testdata/sf0.001"
