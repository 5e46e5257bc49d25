import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, payload int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, near copies, columns with clashing names."""
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "Épsilon", "zeta.", "the", "of", "and", "über", "naïve", "x1"]
    long = " ".join(rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(30_000))
    base = [" ".join(rng.choice(vocabulary) + str(rng.randrange(99)) for _ in range(80)) for _ in range(12)]
    rows = [
        (1, None, None, None, None, "k", 1),
        (2, "", "en", "s", 0, None, None),
        (3, " \n\t ", "en", "s", 4, None, None),
        (4, "one", "en", "s", 3, None, None),
        (5, "one two", "fr", None, 7, None, None),
        (None, "one two", "fr", None, 7, None, None),
        (None, "without id", "de", "s", 10, None, None),
        (6, long, "en", "s", len(long), None, None),
        (7, long, "en", "s", len(long), None, None),
        (8, "12345 67890 !!", "en", "s", 14, None, None),
        (9, "same row", "en", "s", 8, "a", 2),
        (9, "same row", "en", "s", 8, "a", 2),
    ]
    for i, text in enumerate(base):
        rows += [(100 + 10 * i + k, text.replace("the", "THE", k % 2), ["en", "fr", "de", None][i % 4], "hot", len(text), None, None) for k in range(4)]
        rows.append((100 + 10 * i + 5, text + " added", "en", "hot", len(text), None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]
