import random

import pytest

WORDS = "the of and to in river stone light paper window garden market silver bridge winter summer letter number table music forest island engine valley".split()


@pytest.fixture(scope="session")
def prose():
    """A maker of random prose: prose(seed, words)."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(("", "ly", "s", "er")) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (doc_id, text) with columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, "x", 1, 2.0, "y", None) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, key string, n int, score double, kind string, sid long")

    return make
