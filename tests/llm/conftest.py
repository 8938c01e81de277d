import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, node string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Odd rows: nulls in every column, empty, blank and long texts, copies, near copies, repeated rows."""
    rng = random.Random(4)
    shared, base = prose(rng, 30), prose(rng, 80)
    words = base.split()
    texts = [None, "", "", "   \n", "one two", "ONE two", "é" * 60, prose(rng, 4000), shared, base, base, base.upper()]
    texts += [" ".join(words[:k] + ["edit"] + words[k + 1 :]) for k in (3, 40, 77)]
    texts += [f"{prose(rng, 20)} {shared} {prose(rng, 10)}" for _ in range(6)]
    texts += [prose(rng, rng.randrange(1, 60)) for _ in range(20)]
    rows = [(100 - i, t, "en", "a" if i % 3 else None, len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[20], (None, "null id", None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
