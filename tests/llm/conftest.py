import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re", "su", "ta") for b in ("ne", "po", "ri", "va") for c in ("", "n", "s", "th", "mo", "da", "li", "xu")]


@pytest.fixture
def prose():
    """prose(seed, n): n words, the same for the same seed."""

    def make(seed: int, n: int) -> list[str]:
        r = random.Random(seed)
        return [r.choice(WORDS) + r.choice(["", "", "", r.choice(WORDS)]) for _ in range(n)]

    return make


@pytest.fixture
def docs(spark):
    """docs(rows): a documents table of (doc_id, text) or (doc_id, text, source), with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", -1, 0.5) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key int, component string, size int, score double")

    return make


@pytest.fixture
def odd(prose):
    """Null ids and texts, empty and blank texts, repeated rows and ids, one very long text and one very long word."""
    a, long_ = " ".join(prose(1, 80)), " ".join(prose(2, 30_000))
    return [(1, a), (1, a), (2, a), (3, None), (4, ""), (5, " \n\t "), (None, a), (None, None), (6, long_), (7, "z" * 50_000), (8, "!!! ..."), (9, "one two"), (9, "other text of the same id"), (10, long_)]
