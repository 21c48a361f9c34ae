import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li", "su") for b in ("n", "r", "st") for c in ("a", "e", "io", "u")]


@pytest.fixture(scope="session")
def prose():
    """Reproducible texts: ``prose(seed, words)``."""

    def make(seed, words=80):
        rng = random.Random(seed)
        out = []
        for i in range(words):
            out.append(rng.choice(WORDS))
            out.append("\n" if i % 12 == 11 else " ")
        return "".join(out[:-1])

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns whose names operators use inside."""
    long = " ".join(prose(99, 5000).split() * 3)
    rows = [
        (1, prose(1), "a", 1, "x"),
        (2, prose(1), "b", 2, "x"),
        (2, prose(1), "b", 2, "x"),
        (3, None, None, None, None),
        (None, prose(2), "c", 3, "y"),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (4, "", "a", 4, "z"),
        (5, " \t\r\n ", "a", 5, "z"),
        (6, long, "a", 6, "z"),
        (7, "one two", "a", 7, "z"),
        (8, "one two", "a", 8, "z"),
        (9, "É ß 日本 😀 \x00 \\ </s>", "a", 9, "z"),
    ]
    # the last three names are also used by operators
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row long, kept string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, row long, kept string")
