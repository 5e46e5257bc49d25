"""Postings gathered in rows, phrases intersected in rows."""

import pytest

from threadloom import plans
from threadloom.operators import search as S

TEXTS = [(1, "the the of the of"), (2, ""), (3, "of the"), (4, "Über über, the the"), (5, None)]


@pytest.mark.parametrize("tokens", [1, 3, 1_000_000])
def test_slices_gather_the_same_postings(spark, monkeypatch, tokens):
    whole = S._gathering
    monkeypatch.setattr(S, "_gathering", lambda fields: whole(fields, tokens))
    docs = spark.createDataFrame(TEXTS, "id long, text string").coalesce(1)
    got = {(r.id, r.term): (r.positions, r.length) for r in S.build_index(docs, "id", ["text"]).postings.collect()}
    assert got == {(1, "the"): ([0, 1, 3], 5), (1, "of"): ([2, 4], 5), (3, "of"): ([0], 2), (3, "the"): ([1], 2), (4, "uber"): ([0, 1], 4), (4, "the"): ([2, 3], 4)}


def test_phrases_with_a_term_twice(spark):
    index = S.build_index(spark.createDataFrame(TEXTS, "id long, text string"), "id", ["text"])
    phrases = spark.createDataFrame([(1, 0, ["the", "the", "of"]), (2, 0, ["the", "of"]), (3, 0, ["the", "gone"])], "query int, phrase int, terms array<string>")
    assert {(r.query, r.id): r.n for r in S.occurrences(index, phrases).collect()} == {(1, 1): 1, (2, 1): 2}


def test_tokens_are_counted_without_an_exchange_by_term(spark, sf):
    plan = plans.QUERIES["x31_tokens"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and ", term" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
