import random

import pytest

VOCABULARY = [a + b + c for a in ("th", "er", "an", "on", "st", "re") for b in ("a", "e", "i", "ou") for c in ("nd", "ng", "ble", "r", "")]


def prose(rng, n):
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    for i in range(9, n, 11):
        words[i] += "."
    return " ".join(words)


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def documents(spark):
    """Makes a documents frame of (id, text) pairs, with extra columns whose names clash with the operators' own."""

    def make(rows):
        kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, _id int, h string"
        return spark.createDataFrame([(i, t, "en", "s1", len(t or ""), "x", 1, "y") for i, t in rows], kind)

    return make
