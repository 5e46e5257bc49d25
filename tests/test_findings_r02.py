"""Cases of the second review: lexicons of any size, blank texts, open references, numbers that begin a line."""

from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom import plans
from threadloom.functions.mail import html_text
from threadloom.operators import lexicon as L
from threadloom.operators import minutes as M

TEXTS = [(1, "a small Ring for P3.1 and P25i"), (2, "red  widget (red)"), (3, ""), (4, None), (5, "E7: big-ring, ring E7i"), (1, "a small Ring for P3.1 and P25i")]
NAMES = [("P3", "Small ring"), ("P3", "hoop"), ("P25", "made"), ("P9", "ring"), ("P8", "RING"), ("E7", "big-ring"), ("E8", "(red)"), ("P2.1", "widget"), ("P4", "red"), ("P5", "the")]


def test_expansion_by_joins_equals_a_local_lexicon(spark):
    names = spark.createDataFrame(NAMES, "id string, label string")
    more = spark.range(250_000).select(F.concat(F.lit("E9"), "id").alias("id"), F.concat(F.lit("label "), "id").alias("label"))
    labels, ids = defaultdict(list), defaultdict(set)
    for i, label in NAMES:
        labels[i].append(label)
        if "." not in i and label != "the":
            ids[label.lower()].add(i)
    labels, ids = {k: sorted(v) for k, v in labels.items()}, {k: sorted(v) for k, v in ids.items()}
    want = sorted(((q, ",".join(L.expand(t or "", labels, ids))) for q, t in TEXTS), key=str)
    asked = spark.createDataFrame(TEXTS, "query int, text string")
    assert sorted(((r.query, r.terms) for r in L.expanded(asked, names.unionByName(more), ["THE"]).collect()), key=str) == want
    assert any(terms for _, terms in want)


@pytest.fixture
def folder(spark, tmp_path):
    texts = [(1, ""), (2, " \n "), (3, "a" * 2001), (4, "\n" * 1500 + "b " * 400), (5, "c"), (6, ("d" * 90 + "\n") * 30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_every_text_is_chunked(spark, folder):
    got = {r.doc_id: (r.bounded, r.contained, r.single) for r in plans.QUERIES["h3_chunks"](spark, folder).collect()}
    assert got == {1: (True, True, True), 2: (True, True, True), 3: (True, True, False), 4: (True, True, None), 5: (True, True, True), 6: (True, True, False)}


def test_references_without_a_semicolon():
    source = "<p>a &amp; b &lt;c&gt; d&amp</p><p>&#65 &#66; AT&T; &amp&amp;</p>"
    assert html_text(source) == "a & b <c> d&\nA B AT&T; &&"
    assert html_text(source, closed=True) == "a & b <c> d&amp\n&#65 B AT&T; &amp&"


def test_bare_numbers_where_the_source_numbers(spark):
    own = spark.createDataFrame([("d", 0, None, "56.187.231.175 is an address"), ("d", 1, None, "56) done")], "doc string, pos int, style string, text string")
    register = spark.createDataFrame([(56,)], "issue int")
    heads = lambda *more: [r.heading for r in M.sections(own, register, *more).orderBy("section").collect()]
    assert heads() == ["56.187.231.175 is an address", "56) done"]
    assert heads(F.col("pos") == 1) == [M.PREAMBLE, "56) done"]


@pytest.mark.parametrize("name", ["j3_overlap_link", "h1_build_threads"])
def test_late_messages_have_a_time(spark, sf, tmp_path, name):
    late = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("conv_id", F.col("conv_id") + 25_000)
    late.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = plans.QUERIES[name](spark, str(tmp_path)), con.sql(plans.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())
