import random

import pytest

from tests.llm import plain

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHING = ("id", "h", "n", "key", "chunk", "row", "start", "units", "component", "label", "fold", "_id", "_h", "m", "signature", "value_hash")


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Missing values, empty and very long texts, ties, repeated rows."""
    long = words(1, 6_000)
    base = words(2, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "s1"), (2, " ".join(near), "en", "s1"), (3, base.upper(), "de", None), (4, None, None, None), (5, "", "en", "s2"),
        (6, " \t\n ", "en", "s2"), (7, "one", "en", "s2"), (8, "ONE", "en", "s2"), (9, long, "en", "s1"), (10, "a " * 3_000, "en", "s1"),
        (11, "a" * 5_000, "en", "s1"), (12, long[:20_000] + " tail " + base, None, "s3"), (13, words(3, 12), "fr", "s3"),
        (14, words(3, 12), "fr", "s3"), (15, "é ü x y 日本語 \x1c z\x0bq", "fr", "s3"), (1, base, "en", "s1"), (1, base, "en", "s1"),
        (16, "line\n" * 50 + words(4, 80), "en", "s1"), (17, words(5, 300) + " " + words(6, 90), "en", "s1"),
        (18, words(6, 90) + "\n\n" + words(7, 200), "en", "s4"), (None, base, "en", "s1"), (None, None, None, None), (None, words(6, 90), "en", "s1"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, DOCUMENTS)
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [tuple(r) for r in small.collect()]


@pytest.fixture(scope="session")
def plainly():
    return plain
