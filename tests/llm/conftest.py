from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

# Names that the operators also use inside, with values they must not touch.
CLASHING = "n long, id string, text2 string, node string, k long, row long, slot long, score double, rank int"


@pytest.fixture(scope="session")
def prose():
    """Words of a small made-up language."""
    rng = random.Random(7)
    parts = ["th", "an", "er", "ou", "in", "st", "le", "qu", "ä", "ñ"]
    vocabulary = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


@pytest.fixture(scope="session")
def odd_rows(prose):
    """(doc_id, text, lang, source): nulls in every column, empty, long and repeated texts, repeated rows and ids."""
    long = prose(30_000, 1)
    base = prose(120, 2).split()
    near = [" ".join(w for i, w in enumerate(base) if i != drop) for drop in (0, 118, 119)]
    rows = [(1, "", "en", "a"), (2, None, None, "b"), (3, "one", "en", None), (4, "one two", "de", "b"),
            (5, long, "en", "a"), (6, long, "en", "a"), (7, " ".join(base), "en", "b"), (8, near[0], None, "c"),
            (9, near[1], "en", "c"), (10, near[2], "en", "c"), (11, prose(200, 3), "en", "a"),
            (11, prose(200, 3), "en", "a"), (11, prose(90, 4), "en", "d"), (None, prose(60, 5), "en", "a"),
            (None, None, None, None), (14, "x" * 3000, "en", "e"), (15, "ab" * 700, "en", "e"), (16, "   \n\t ", "en", "a"),
            (17, "Same Words HERE again", "en", "a"), (18, "same words here AGAIN", "en", "b"),
            (19, "fußgänger ÄÖ é 漢字 " * 30, "de", "f"), (20, prose(500, 6) + " " + prose(120, 2), "en", "a")]
    return rows + [(100 + i, prose(40 + i, 50 + i), "en", "abc"[i % 3]) for i in range(40)]


SHAPE = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with extra columns under clashing names."""
    extra = (7, "x", None, "y", 1, 2, 3, 0.5, 4)
    return spark.createDataFrame([r + extra for r in odd_rows], f"{SHAPE}, {CLASHING}").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], T.StructType(odd.schema.fields))
