"""Cases of the second review's findings on searches that were stopped by time: what they share is done once and for what is asked."""

import math

import pytest

from threadloom import plans
from threadloom.operators import search as S
from threadloom.plans import search as P

TEXTS = [(1, "the the of the of", "en"), (2, "", None), (3, "of the", "the"), (4, "Über über, the the", "fr"), (5, None, "of"), (6, "none here", "en")]


@pytest.mark.parametrize("tokens", [1, 3, 1_000_000])
def test_an_index_of_some_terms_is_part_of_the_whole(spark, tmp_path, monkeypatch, tokens):
    gather = S._gathering
    monkeypatch.setattr(S, "_gathering", lambda fields, **more: gather(fields, tokens, **more))
    docs = spark.createDataFrame(TEXTS, "id long, text string, lang string").coalesce(2)
    rows = lambda index: {(r.field, r.term, r.id, tuple(r.positions), r.length) for r in index.postings.collect()}
    whole, some = (S.build_index(docs, "id", ["text", "lang"], True, terms) for terms in (None, ["the", "uber", "gone"]))
    assert rows(some) == {r for r in rows(whole) if r[1] in ("the", "uber")} and len(rows(some)) == 5
    assert sorted(some.lengths.collect()) == sorted(whole.lengths.collect()) and some.lengths.count() == 6
    assert [S.write_index(x, f"{tmp_path}/{k}") for k, x in enumerate((whole, some))] == [6, 6]
    stored = [S.read_index(spark, f"{tmp_path}/{k}") for k in range(2)]
    assert stored[0].docs == stored[1].docs == 6 and stored[0].mean == stored[1].mean == pytest.approx(18 / 6)
    asked = S.phrases_of(spark.createDataFrame([(1, "the Über"), (2, "the-the gone"), (3, "gone")], "query int, text string"))
    scores = [sorted(S.bm25(x, asked, {"text": 1.0, "lang": 2.0}).collect()) for x in (whole, some, *stored)]
    assert scores[0] == scores[1] == scores[2] == scores[3] and len(scores[0]) == 5


def test_an_index_of_no_rows_or_no_hits(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "id long, text string, lang string")
    for name, own, terms, n in (("hits", docs, ["gone"], 6), ("rows", docs.where("id < 0"), ["the"], 0), ("terms", docs, [], 6)):
        assert S.write_index(S.build_index(own, "id", ["text"], True, terms), f"{tmp_path}/{name}") == n
        asked = S.phrases_of(spark.createDataFrame([(1, "the gone")], "query int, text string"))
        assert S.bm25(S.read_index(spark, f"{tmp_path}/{name}"), asked, {"text": 1.0}).collect() == []


@pytest.mark.parametrize("name", ["i6_filtered_widened", "a14_rrf", "i4_weighted_rrf", "i6_hybrid_search", "i7_episode_search", "i8_document_search"])
def test_searches_sort_only_what_they_ask_for(spark, sf, monkeypatch, name):
    """The whole index of all words used to be sorted and stored for the eleven words of a batch."""
    monkeypatch.setattr(P, "_stored", {})
    alone = sorted(plans.QUERIES[name](spark, sf).collect())
    assert [len(key) for key in P._stored] == [4] and next(iter(P._stored))[3] == ("and", "eauaux", "edtion", "ertion", "la", "le", "of", "reanin", "the", "thention", "token")
    (path, _), *_ = P._stored.values()
    assert {r.term for r in spark.read.parquet(f"{path}/postings").select("term").distinct().collect()} <= set(next(iter(P._stored))[3])
    P._stored.clear()
    P.index_of(spark, sf, "text")
    assert sorted(plans.QUERIES[name](spark, sf).collect()) == alone and [len(key) for key in P._stored] == [3]  # what is stored whole is used


def test_a_norm_is_summed_once_a_vector(spark):
    """It used to be summed again for every element, by the square of the width."""
    vectors = [(1, [3.0, 4.0]), (2, [0.5] * 4), (3, None), (4, [1.0, None]), (5, [])]
    df = spark.createDataFrame(vectors, "id int, v array<float>").select("id", S.unit(S.F.col("v")).alias("u"))
    assert "/ SQRT(" not in df._jdf.queryExecution().optimizedPlan().toString().upper()
    got = {r.id: r.u for r in df.collect()}
    assert got[1] == [3 / 5, 4 / 5] and got[2] == [0.5 / math.sqrt(1.0)] * 4 and got[3] is None and got[4] == [None, None] and got[5] == []
