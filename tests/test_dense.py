"""Vector search by groups against all pairs, and widening over a whole store against ranking every pair."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import dense as D
from threadloom.operators import search as S


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    rows = [(n, [float(rng.randrange(-2, 3)) for _ in range(4)] if n % 3 else [1.0, 2.0, 0.5, -1.0]) for n in range(150)]
    rows = [(n, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for n, v in rows] + [(200, None), (201, [1.0, None, 2.0, 0.0]), (202, [3.0, 4.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    asked = vectors.where("id % 20 = 0").select(F.col("id").cast("int").alias("query"), "vector")
    return vectors, asked


def plain(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [40, 100_000])
def test_top_and_ranks_equal_all_pairs(spark, tables, monkeypatch, size):
    monkeypatch.setattr(D, "VECTORS", size)
    vectors, asked = tables
    pairs, found = S.cosine(vectors, asked, "id", "vector"), D.Dense(vectors, asked, "id", "vector")
    names = ("query", "id", "score", "rank")
    assert plain(S.ranked(found.top(7), 7), *names) == plain(S.ranked(pairs, 7), *names)
    wanted = pairs.where("id % 4 = 1 OR id >= 200")
    ranks = S.ranked_all(pairs).join(wanted.select("query", "id"), ["query", "id"])
    assert plain(found.ranks(found.scored(wanted)), "query", "id", "rank") == plain(ranks, "query", "id", "rank")


@pytest.mark.parametrize(("most", "per_thread"), [(3, 2), (9, 2), (60, 1), (40, None)])
def test_widening_equals_ranking_every_pair(spark, tables, most, per_thread):
    vectors, asked = tables
    words = spark.createDataFrame([(0, n, float(n % 7)) for n in range(0, 150, 4)] + [(20, 9, 1.0)], "query int, id long, score double")
    records = vectors.select("id", F.expr("id - id % 2").alias("message"), F.when(F.expr("floor(id / 2) % 5 = 0"), "").otherwise(F.expr("concat('t', floor(id / 2) % 6)")).alias("thread"), F.expr("id % 3 <> 1").alias("open"))
    keep = lambda h: h.where("open")
    args = (records, most, (1.0, 2.0), "hybrid", per_thread, keep, 160)
    names = ("query", "id", "position", "score")
    want = S.hybrid(words, S.cosine(vectors, asked, "id", "vector"), *args)
    assert plain(S.hybrid(words, D.Dense(vectors, asked, "id", "vector"), *args), *names) == plain(want, *names)
