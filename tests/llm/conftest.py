import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ("key", "n", "size", "set", "token", "block", "batch", "bucket", "count", "lead", "root", "target", "taken", "score", "sigs", "id", "__size")


def prose(seed: int, n: int, words="the of sun moon river stone light shade walk talk green blue".split()) -> str:
    dice = random.Random(seed)
    drawn = [dice.choice(words) for _ in range(n)]
    return " ".join(w if w in words[:2] else f"{w}{dice.randrange(40)}" for w in drawn)


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows."""
    a = prose(1, 120)
    near = a.split()
    near[60] = "changed"
    long = "\n".join(prose(1000 + i, 50) for i in range(800))
    rows = [
        (1, a, "en", "s"), (2, None, "en", "s"), (3, "", "de", "s"), (4, " \n\t \x0b\n", None, None), (5, long, "fr", "t"), (6, a, "en", "s"),
        (7, " ".join(near), "en", None), (7, " ".join(near), "en", None), (8, a, None, "s"), (9, "one two", "de", "t"), (10, "one  two", "es", "u"),
        (11, "\U0001F600 ünï çode \x00 nul <|endoftext|> a   b\n\n  c ", "es", "u"), (12, long + " end", "fr", "t"), (None, prose(3, 80), "en", "s"), (13, prose(4, 80), "de", "v"),
        (14, "### $$$ *** !!! " * 30, "en", "v"), (15, "line number one is here\n" * 40, "en", "v"), (16, "line number one is here", "fr", "t"),
    ]
    return [(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_wide(odd):
    """The odd rows with extra columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (9, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
