"""Cases of the second review's growth findings: what a Python worker or a task holds is bounded, with the same results."""

import random
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.functions import chunking as K
from threadloom.functions import cleaning as L
from threadloom.functions import mail as M
from threadloom.functions import rows as R
from threadloom.operators import evals as E
from threadloom.operators import quotes as Q


def test_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(R, "SLICE", 1000)
    column = pa.array(["a" * 400, None, "", "b" * 5000, "c", "é" * 300] * 3)
    parts = [values for (values,) in R.slices(column)]
    assert [x for values in parts for x in values] == column.to_pylist()
    assert all(sum(len((x or "").encode()) for x in v[:-1]) <= 1000 for v in parts) and len(parts) > 4
    assert [v for (v,) in R.slices(pa.array([], pa.string()))] == [[]]


def test_packing_sees_bounded_slices(spark, sf, monkeypatch):
    """A batch of texts used to be turned into Python whole."""
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.c for r in own.select("doc_id", K.sentence_pack_udf("text").alias("c")).collect()}
    assert got == {r.doc_id: K.sentence_pack(r.text or "") for r in own.collect()} and len(got) > 100
    column = pa.array([r.text for r in own.collect()] * 40)
    assert max(sum(len((x or "").encode()) for x in v) for (v,) in R.slices(column)) < column.nbytes / 4


def test_functions_of_rows(spark):
    own = spark.createDataFrame([(k, None if k == 3 else "x. " * k) for k in range(9)], "id int, text string")
    lengths = R.per_row(lambda t: None if t is None else {"n": len(t)}, K.T.MapType(K.T.StringType(), K.T.IntegerType()))
    both = R.per_row_of_two(lambda t, n: len(t or "") * n, K.T.LongType())
    got = {r.id: (r.m, r.b) for r in own.select("id", lengths("text").alias("m"), both("text", F.col("id")).alias("b")).collect()}
    assert got == {k: (None if k == 3 else {"n": 3 * k}, 0 if k == 3 else 3 * k * k) for k in range(9)}


def test_pages_and_mails_see_bounded_slices(spark, sf, monkeypatch):
    """Batches of pages and mails used to be turned into Python whole; the functions share one step, which bounds them."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.p for r in pages.select("page_id", M.html_paragraphs_udf("html").alias("p")).collect()}
    assert got == {r.page_id: M.html_paragraphs(r.html) for r in pages.collect()} and len(got) > 20
    fields = {r.page_id: r.f for r in pages.select("page_id", M.html_fields_of("ad")("html").alias("f")).collect()}
    assert fields == {r.page_id: M.html_fields(r.html, "ad") for r in pages.collect()}
    mails = [(1, "Hi\n> one\nbut\n> two\n-- \nA"), (2, None), (3, "plain")]
    own = spark.createDataFrame(mails, "id int, mail string").select("id", L.clean_body_udf("list")("mail").alias("c"))
    assert {r.id: r.c.asDict() for r in own.collect()} == {k: L.clean_body(t, "list") for k, t in mails}
    raw = b"Subject: s\nFrom: A <a@b>\nMIME-Version: 1.0\n\nbody"
    row = spark.createDataFrame([(bytearray(raw),)], "raw binary").select(M.parse_message_udf("raw").alias("m")).first()
    assert row.m.asDict(True) == M.parse_message(raw)
    assert all(f.evalType == K.sentence_pack_udf.evalType for f in (M.html_paragraphs_udf, M.html_text_udf, M.html_rows_udf, M.parse_message_udf, M.decode_udf, M.header_udf))


def test_verdicts_follow_bounded_slices(monkeypatch):
    """Units used to be turned into Python a batch at a time."""
    seen = []

    def watched(*columns):
        for part in slices(*columns):
            seen.append(sum(len(x or "") for x in part[0]))
            yield part

    slices = R.slices
    monkeypatch.setattr(R, "SLICE", 300)
    monkeypatch.setattr(Q, "slices", watched)
    texts = ["it was a fine day for a walk", None, "x" * 500, "a fine day for all of us"] * 20
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    asked = ["a fine day for all", "fine day for a wal", "nowhere to be found"]
    got = {r["part"]: r["prefix"] for b in Q._followed(iter([batch]), asked, 12) for r in b.to_pylist()}
    assert got == {n: max(Q.longest_prefix(n, t or "") for t in texts) for n in asked if n[:12] in " ".join(t or "" for t in texts)}
    assert len(seen) > 20 and max(seen) <= 1000


def test_longest_runs_take_few_looks():
    """Every place of a phrase used to be looked for, and a text's form was made again for every phrase."""

    class Text(str):
        looks = 0

        def __contains__(self, part):
            Text.looks += 1
            return str.__contains__(self, part)

    rng = random.Random(5)
    letters = lambda n, of="abcdefgh ": "".join(rng.choice(of) for _ in range(n))
    for k in range(400):
        b = letters(rng.randrange(300), "ab ’é,"[: 2 + k % 5])
        cut = rng.randrange(len(b) + 1)
        a = letters(rng.randrange(20), "ab ’") + b[cut : cut + rng.randrange(40)] + letters(rng.randrange(20), "ab")
        one, two = Q._form(a), Q._form(b)
        want = SequenceMatcher(None, one, two, autojunk=False).find_longest_match(0, len(one), 0, len(two)).size
        assert Q.longest_run(one, two) == want
        assert Q.closest(b, a) == (round(want / len(one), 3) if one and two else 0.0)
    b = letters(4000)
    a = letters(150) + b[1000:1060] + letters(150)
    (one, tails), (two, there) = Q._phrase_form(a), Q._text_form(b)
    assert Q.longest_run(one, Text(two), there[tails].tolist()) >= 50 and Text.looks < len(one) / 2


def test_terms_in_a_row_are_found_within_units(spark, monkeypatch):
    """All words of all units used to be exploded and grouped by place."""
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    texts = [(k, words(rng.randrange(12))) for k in range(120)] + [(200, None), (201, "A B, a. b"), (202, "a a a a a")]
    terms = [(f"c{k % 5}", words(1 + k % 4)) for k in range(25)] + [("c5", "A-b"), ("c5", "a a a"), ("c5", "zz"), ("c6", "zz a"), ("c7", "."), ("c5", "a b")]
    tokens = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    padded = lambda t: f" {' '.join(tokens(t))} "
    want = {}
    for case in {c for c, _ in terms}:
        own = {t for c, t in terms if c == case and tokens(t)}
        counts = [(-sum(padded(t) in padded(text) for t in own), k) for k, text in texts]
        if min(counts)[0]:
            want[case] = (min(counts)[1], -min(counts)[0])
    units = spark.createDataFrame(texts, "unit int, text string").selectExpr("unit", "unit AS ord", "text")
    asked = spark.createDataFrame(terms, "case string, term string")
    for block in (10_000, 7):
        monkeypatch.setattr(E, "BLOCK", block)
        found = E.phrase_novelty(asked, units)
        assert {r.case: (r.unit, r.shared) for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array([["a", "b"], ["c"], ["b", "a", "b"]])], names=["unit", "ord", "words"])
    for tokens_held in (1, 1_000_000):
        got = [tuple(r.values()) for b in E._in_a_row(iter([batch]), [["a", "b"], ["b", "c"], ["b"]], tokens_held) for r in b.to_pylist()]
        assert sorted(got) == [("a b", 1, 1), ("a b", 3, 3), ("b", 1, 1), ("b", 3, 3)]
