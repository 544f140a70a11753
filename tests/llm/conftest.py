import pytest

#: Columns that clash with names that the operators use.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, n string, doc string, range string, words string, places string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, lang, source]), with further columns of clashing names."""

    def build(rows):
        full = [(r[0], r[1], *(r[2:] + ("en", "s")[len(r) - 2 :])) for r in rows]
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), 5, "x", "y", "z", "w", "v") for i, t, lang, source in full], DOCS)

    return build


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))
