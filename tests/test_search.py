import random
import sqlite3

import pytest

from threadloom.operators import lexicon as L
from threadloom.operators import search as S

ROWS = [
    (1, "Types", "Ann", "a thesaurus of types and E55", "E55"), (2, "Re: types", "Bob", "vocabularies and a thesaurus, E52 not that", "E52"), (3, "Thesaurus", "E55 Carl", "nothing here at all", ""),
    (4, "places", "Dora", "the thesaurus thesaurus of naïve names", "E53 E55"), (5, "misc", "Eve", "quite another matter", ""), (6, "more", "Fay", "vocabularies", ""), (7, "of types", "Gus", "a long line of words about nothing in particular and more", ""),
]
FIELDS = ["subject", "from_name", "body", "entities"]
WEIGHTS = {"subject": 2.0, "from_name": 0.0, "body": 1.0, "entities": 4.0}


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(ROWS, "id int, subject string, from_name string, body string, entities string")
    return S.build_index(docs, "id", FIELDS)


@pytest.mark.parametrize("text", ["naive", "Naïve NAMES", "thesaurus", "E55 types", "vocabularies thesaurus", "a-thesaurus", "carl nothing", '"quoted" of* NEAR(', ""])
def test_bm25_equals_sqlite(spark, index, text):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(subject, from_name, body, entities, tokenize='unicode61')")
    con.executemany("INSERT INTO t(rowid, subject, from_name, body, entities) VALUES (?, ?, ?, ?, ?)", ROWS)
    terms = ['"' + w.replace('"', '""') + '"' for w in text.split() if any(c.isalnum() for c in w)]
    want = {r: -s for r, s in con.execute("SELECT rowid, bm25(t, 2.0, 0.0, 1.0, 4.0) FROM t WHERE t MATCH ?", (" OR ".join(terms),))} if terms else {}
    queries = spark.createDataFrame([(1, text)], "query int, text string")
    got = {r.id: r.score for r in S.bm25(index, S.phrases_of(queries), WEIGHTS).collect()}
    assert set(got) == set(want)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_first_row_of_an_id_counts(spark):
    docs = spark.createDataFrame([(1, "old"), (1, "new")], "id int, body string").coalesce(1)
    assert {r.term for r in S.build_index(docs, "id", ["body"]).postings.collect()} == {"old"}


def test_fusion(spark):
    ranking = lambda ids: spark.createDataFrame([(1, x, n) for n, x in enumerate(ids, 1)], "query int, id string, rank int")
    got = {r.id: r.score for r in S.fuse([ranking("ab"), ranking("bc")]).collect()}
    assert got["a"] == pytest.approx(1 / 61) and got["b"] == pytest.approx(1 / 62 + 1 / 61) and got["c"] == pytest.approx(1 / 62)
    flipped = {r.id: r.score for r in S.fuse([ranking("a"), ranking("c")], [1.0, 2.0]).collect()}
    assert flipped["c"] > flipped["a"]
    with pytest.raises(ValueError):
        S.fuse([ranking("a")], [1.0, 2.0])
    assert S.fuse([ranking("")]).count() == 0


def test_weights_and_modes(spark):
    assert S.dense_weight("what is e55i about") == 1.0 and S.dense_weight("a photograph") == 2.0
    with pytest.raises(ValueError):
        S.hybrid(None, None, None, 5, mode="fuzzy")


def test_diversity_equals_the_greedy_rule(spark):
    rng = random.Random(1)
    rows = [(q, n, f"m{m}", "" if m % 5 == 0 else f"t{m % 4}") for q in range(20) for n, m in enumerate([rng.randrange(15) for _ in range(25)], 1)]
    got = {}
    for r in S.diverse(spark.createDataFrame(rows, "query int, place int, message string, thread string"), 7).collect():
        got.setdefault(r["query"], {})[r.position] = r.place
    for q in range(20):
        seen, per, want = set(), {}, []
        for _, place, m, t in sorted(r for r in rows if r[0] == q):
            if m in seen or t and per.get(t, 0) >= 2:
                continue
            seen.add(m)
            per[t] = per.get(t, 0) + 1
            want.append(place)
        assert [got[q][k] for k in sorted(got[q])] == want[:7]


def test_filters(spark):
    rows = [(1, "Ann@x.org", "2004-05-01", ["E1"]), (2, None, None, ["E2"]), (3, "bob@x.org", "2010-01-01", ["E1", "E2"])]
    hits = spark.createDataFrame(rows, "id int, author string, date string, entities array<string>")
    ids = lambda **k: {r.id for r in S.filtered(hits, **k).collect()}
    assert ids(author="X.ORG") == {1, 3} and ids(after=2005) == {3} and ids(before=2005) == {1, 2} and ids(entity="E1") == {1, 3}


def test_expansion():
    labels, ids = {"E55": ["Type"]}, {"time span": ["E52"], "span": ["E99"], "type": ["E55"]}
    assert L.expand("about E55", labels, ids) == ["Type"]
    assert L.expand("a time span", labels, ids) == ["E52"]  # the longer label claims its words
    assert L.expand("the type E55", labels, ids) == []  # nothing that the query holds already
    assert L.expand("E55.1 and P25i", labels | {"P25": ["moved"]}, ids) == ["Type", "moved"]  # suffixes fold into the base
    assert L.expand("in timespans", labels, ids) == [] and L.expand("spanning E99 span", labels, ids) == []


def test_whole_search(spark, index, tmp_path):
    path = f"file://{tmp_path}/index"
    assert S.write_index(index, path, buckets=4) == 7
    stored = S.read_index(spark, path)
    phrases = S.phrases_of(spark.createDataFrame([(1, "thesaurus of"), (2, "E55 vocabularies")], "query int, text string"))
    take = lambda i: {(r.query, r.id): round(r.score, 9) for r in S.bm25(i, phrases, WEIGHTS).collect()}
    assert take(stored) == take(index) and take(stored)
    assert S.write_index(index, path, buckets=2) == 7  # built anew
    stored = S.read_index(spark, path)
    assert take(stored) == take(index)
    vectors = spark.createDataFrame([(i, [float(i == k) + 0.1 for k in range(7)]) for i in range(1, 8)], "id int, v array<double>")
    assert S.write_vectors(vectors, "id", "v", f"file://{tmp_path}/vectors") == 7
    dense = spark.read.parquet(f"file://{tmp_path}/vectors")
    records = spark.createDataFrame([(i, f"m{i}", f"t{i}", "ann" if i % 2 else "bob", f"{2000 + i}-01-01", ["E55"] if i < 5 else []) for i in range(1, 8)], "id int, message string, thread string, author string, date string, entities array<string>")
    queries = spark.createDataFrame([(1, "thesaurus", [0.0] * 6 + [1.0]), (2, "about E55", [1.0] + [0.0] * 6)], "query int, text string, vector array<double>")
    find = lambda **k: {(r.query, r.position): r.id for r in S.search(queries, stored, dense, records, **({"most": 3, "weights": WEIGHTS} | k)).collect()}
    assert find()[1, 1] in (1, 2, 3, 4) and len(find()) == 6
    assert find(mode="vector")[1, 1] == 6 and find(mode="bm25")[2, 1] in (1, 3, 4, 7)
    assert set(find(author="BOB", after=2003).values()) <= {4, 6} and set(find(entity="E55").values()) <= {1, 2, 3, 4}
    names = spark.createDataFrame([("E55", "vocabularies")], "id string, label string")
    assert {2, 6} <= set(find(mode="bm25", names=names, most=7).values())
    with pytest.raises(ValueError):
        find(mode="fuzzy")
    kinds = spark.createDataFrame([("a", "narrative"), ("b", "issue")], "id string, kind string")
    assert [r.id for r in S.of_kinds(kinds, None, ["narrative"], ["narrative", "issue"]).collect()] == ["a"] and S.of_kinds(kinds, "issue", ["narrative"], ["narrative", "issue"]).count() == 1
    with pytest.raises(ValueError, match="unknown kind x"):
        S.of_kinds(kinds, ["x"], ["narrative"], ["narrative", "issue"])
