import random

import pytest

CLASHING = ("row", "key", "doc", "n", "word", "words", "at", "label", "digest", "piece", "group", "host", "text_2")


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text[, lang, source]) with further columns whose names operators use themselves."""
    def make(rows, extra=True):
        full = [(*r, *(("en", "src0")[len(r) - 2:] if len(r) < 4 else ()), len(r[1] or "")) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        if extra:
            full = [(*r, *range(len(CLASHING))) for r in full]
            schema += "".join(f", `{c}` int" for c in CLASHING)
        return spark.createDataFrame(full, schema)
    return make


@pytest.fixture
def babble():
    """Seeded texts from a small vocabulary."""
    def make(n, seed=0, vocabulary=400, low=30, high=60):
        rng = random.Random(seed)
        words = [f"w{i}x" for i in range(vocabulary)]
        return [" ".join(rng.choices(words, k=rng.randint(low, high))) for _ in range(n)]
    return make
