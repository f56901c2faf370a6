import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the of and to in a is that it for was on as with be by at this are or".split()


def prose(rng, n, common=0.4):
    return " ".join(rng.choice(COMMON) if rng.random() < common else "".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es", "or"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edge_rows():
    rng = random.Random(5)
    long = "\n".join(prose(rng, 40) for _ in range(400))
    return [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 4), (4, "one", "en", None, 3), (5, "one two three four", "en", "a", 18),
        (6, "x y z\nx y z\n\n\nx  y z #$%", "de", "b", 22), (7, long, "en", "b", len(long)), (7, long, "en", "b", len(long)), (8, "é" * 50 + " Straße naïve \U0001f600 日本語", "fr", "b", 70),
        (None, prose(rng, 120), "en", "c", 1), (9, prose(rng, 120), None, None, None), (10, "12345 67890 --- !!!", "en", "c", 19), (11, "\x00\x01 a\x0bb\x0cc", "xx", "c", 9),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """Null and empty values in every column, short, long, repeated and odd texts, and extra columns named like computed ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), DOCS)
    extra = {c: F.lit(7) for c in ("n_words", "kept", "row", "row_key", "score", "node", "label", "pos", "term", "shard", "held_out", "replacements", "word")}
    return df.withColumns(extra).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
