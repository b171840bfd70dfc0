import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, key long, component_id long, toxic string, mark int, gone long, __gone long, __text string"


def frame(spark, rows):
    """Documents with more columns, of names that the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0.5, "x", 7, -1, "no", 3, 6, 5, "t") for d, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGES = [(900, None), (901, ""), (902, " \n\t "), (903, "a"), (903, "a"), (904, "Ünï çödé — 日本語 😀 ́x İ"), (905, "z" * 70_000), (906, "\x00 \x1c\x85\xa0|<|endoftext|>")]


@pytest.fixture(scope="session")
def edges(spark):
    rng = random.Random(4)
    return frame(spark, [*EDGES, (907, words(rng, 30_000))])


@pytest.fixture(scope="session")
def edge_rows(edges):
    return [(r.doc_id, r.text) for r in edges.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
