import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, code string, sig string, n int, size int, key string"


def prose(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs():
    """Rows with nulls, empty and long texts, repeats, short texts, near copies; (doc_id, text, lang, source)."""
    base, long = prose(1, 60), prose(2, 5000)
    near = base[:30] + ["changed"] + base[31:]
    shared = prose(3, 45)
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(base), "en", "a"), (3, " ".join(near), "en", "b"), (4, None, "en", "a"), (5, "", None, None),
        (6, " \t\n ", "fr", "b"), (7, "one", "fr", "b"), (8, "one two", "fr", "b"), (9, "One TWO", "de", "b"), (10, " ".join(long), "en", "a"),
        (11, " ".join(long[:4990] + prose(4, 10)), "en", "a"), (12, " ".join(prose(5, 20) + shared), "en", "a"), (13, " ".join(shared + prose(6, 25)), "en", "c"),
        (14, "x " * 200, "en", "c"), (15, " ".join(shared[:19]), "en", "c"), (16, " ".join(shared[:20]), "en", None), (17, "Ünï çödé – ﬁn x", "de", "c"),
        (None, " ".join(base), None, "a"), (20, "same row here", "es", "c"), (20, "same row here", "es", "c"),
    ]
    return rows


@pytest.fixture()
def frame(spark):
    """A frame of documents with further columns whose names operators use inside."""

    def make(rows):
        full = [(*r, len(r[1] or ""), "code", "sig", 1, 2, "key") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make
