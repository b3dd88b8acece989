import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, bucket int, node string, size long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "ri") for b in ("ra", "do", "ten", "vil", "pos", "gu")]


@pytest.fixture
def make(spark):
    """docs from texts or (id, text, source) rows, with extra columns whose names clash with internal ones."""

    def run(rows):
        full = []
        for i, r in enumerate(rows):
            d, t, s = r if isinstance(r, tuple) else (i, r, f"s{i % 2}")
            full.append((d, t, "en", s, len(t or ""), 1, "x", 2, "y", 3))
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return run


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture
def awkward():
    """Nulls in any column, empty and white texts, ties, repeated rows, equal ids, a very long text."""
    a = prose(1, 120)
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (None, a, "a"), (None, a, "a"), (4, a, None), (4, a, None), (5, a + " tail", "b"), (5, prose(2, 90), "b"), (6, prose(3, 30000), "b"), (7, "x", "a"), (8, "\n\n" + a, "a")]
