import random

import pytest

WORDS = [a + b for a in ("lo", "ra", "ti", "mo", "be", "su", "ka", "ne") for b in ("n", "ra", "to", "li", "ves", "dor", "ka", "mi", "pel", "sun")]


@pytest.fixture
def prose():
    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture
def table(spark):
    """Documents with names that operators use themselves, and the columns in another order."""

    def make(rows, clash=True):
        full = [(i, t, "en", "s", len(t or ""), "x", 1, 2, "y") if len(r) == 2 else (*r, len(r[1] or ""), "x", 1, 2, "y") for r in rows for i, t in [r[:2]]]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h string, n long, p long, _e string")
        return df if clash else df.select("doc_id", "text", "lang", "source", "n_chars")

    return make
