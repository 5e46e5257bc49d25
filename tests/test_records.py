"""Chunk builders, meetings, reading by id, episodes, threads: the rules on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import corpus as C
from threadloom.operators import episodes as P
from threadloom.operators import family as Y
from threadloom.operators import minutes as M
from threadloom.operators import quotes as Q
from threadloom.operators import records as R

def known():
    return F.array(F.lit("E55"), F.lit("P2"))


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


MAIL = "id long, message_id string, ts timestamp, in_reply_to string, references array<string>, subject string, spans array<string>, body string"


def threads_of(spark, *rows):
    from datetime import datetime

    own = [(i, f"<{i}>", ts and datetime.fromisoformat(ts), reply, refs or [], subject, spans or [], body) for i, ts, reply, refs, subject, spans, body in rows]
    found = {}
    for r in C.build_threads(spark.createDataFrame(own, MAIL)).collect():
        found.setdefault(r.thread, []).append((r["index"], r.id))
    return {t: [i for _, i in sorted(m)] for t, m in found.items()}


LONG = " ".join(f"word{k} and" for k in range(30))  # over 200 characters


def test_threads_by_references_and_subjects(spark):
    got = threads_of(
        spark,
        (1, "2010-01-05T10:00:00", None, None, "one", None, "a"), (2, "2010-03-06T10:00:00", "<1>", None, "two", None, "b"), (3, "2010-05-07T10:00:00", None, ["<2>"], "three", None, "c"),
        (4, "2010-01-01T10:00:00", None, None, "Topic", None, "d"), (5, "2010-01-20T10:00:00", None, None, "Re: topic", None, "e"), (6, "2010-03-20T10:00:00", None, None, "topic", None, "f"), (7, None, None, None, "", None, "g"),
    )
    assert got == {"t0000": [7], "t0001": [4, 5], "t0002": [1, 2, 3], "t0003": [6]}


def test_threads_by_quoted_passages(spark):
    wrapped = LONG.replace(" ", "\n")
    row = lambda i, ts, spans, body, reply=None: (i, ts, reply, None, f"s{i}", spans, body)
    assert threads_of(spark, row(1, "2010-01-01T10:00:00", None, f"I said {LONG.upper()} yes"), row(2, "2010-01-03T10:00:00", [wrapped], "so")) == {"t0000": [1, 2]}
    assert len(threads_of(spark, row(1, "2010-01-01T10:00:00", None, LONG), row(2, "2010-01-03T10:00:00", [LONG[:150]], "short quotes do not link"))) == 2
    assert len(threads_of(spark, row(1, "2010-01-01T10:00:00", None, LONG), row(2, "2010-03-03T10:00:00", [LONG], "too late"))) == 2
    assert len(threads_of(spark, row(1, "2010-01-05T10:00:00", None, LONG), row(2, "2010-01-03T10:00:00", [LONG], "never forward"))) == 2
    assert len(threads_of(spark, row(1, "2010-01-01T10:00:00", None, LONG), row(2, "2010-01-03T10:00:00", [LONG], "has a header", "<9>"))) == 2
    few = "x" * 90 + " " + "y" * 80 + " " + "z" * 70  # few, long words, and none at all
    for span in (few, "q" * 230, "a " + "r" * 240):
        assert len(threads_of(spark, row(1, "2010-01-01T10:00:00", None, f"begin{span}end"), row(2, "2010-01-03T10:00:00", [span], "so"))) == 1, span
    second = threads_of(spark, row(1, "2010-01-01T10:00:00", None, LONG), row(2, "2010-01-02T10:00:00", None, LONG), row(3, "2010-01-03T10:00:00", ["nothing", LONG], "any span, the earliest message"))
    assert second == {"t0000": [1, 3], "t0001": [2]}


def test_cleaned_messages(spark):
    raw = frame(spark, "place long, message_id string, date string, from_name string, from_email string, subject string, in_reply_to string, references array<string>, body string", (0, "<a>", None, "A", "a@x", "Re: E55.1 here", None, [], "P2i and E99\n> quoted E7\n> more"), (1, "<a>", None, "A", "a@x", "again", None, [], "later"), (2, None, None, "B", "b@x", None, None, [], "x"), (3, "", None, "B", "b@x", None, None, [], "x"))
    rows = {r.message_id: r for r in C.clean_messages(raw, "mailing list", known()).where("NOT is_duplicate").collect()}
    assert set(rows) == {"<a>", "__no_id_2", "__no_id_3"}
    a = rows["<a>"]
    assert (a.entities, a.entities_historical, a.subject_norm, a.spans) == (["E55", "P2"], ["E7", "E99"], "e55.1 here", ["quoted e7 more"])
    stats = C.clean_stats(C.clean_messages(raw, "mailing list", known())).first()
    assert (stats.messages, stats.duplicates, stats.single_block_quote, stats.thin_reply_context) == (4, 1, 1, 1)


def test_document_chunks(spark):
    long = ("A sentence of some words here. " * 100).strip()
    blocks = frame(spark, "doc_id string, pos int, kind string, concept_id string, section_path array<string>, heading string, text string", ("d", 0, "narrative", None, ["1"], "Intro", long), ("d", 1, "declaration", "E55", ["2"], "E55 Type", "about E55 and E99.1 " * 200), ("d", 2, "narrative", None, ["3"], "End", " the end P2i "), ("g", 0, "narrative", None, ["1"], "G", "guide"))
    specs = frame(spark, "doc_id string, title string, cite string, kind string", ("d", "Doc", "Doc 1", None), ("g", "Guide", "Guide", "guideline"))
    rows = {r.chunk_id: r for r in R.document_chunks(blocks, specs, known()).collect()}
    assert set(rows) == {"d#E55", "d#s0000", "d#s0001", "d#s0002", "g#s0000"} and rows["d#E55"].text.count("E55") == 200
    assert rows["d#E55"].entities == ["E55"] and rows["d#E55"].entities_historical == ["E99"] and rows["d#s0002"].entities == ["P2"]
    assert rows["g#s0000"].kind == "guideline" and rows["d#s0000"].kind == "narrative" and rows["d#s0000"].cite == "Doc 1"
    flat = {r.chunk_id: r for r in R.document_rows(R.document_chunks(blocks, specs, known())).collect()}
    assert flat["d#E55"].entities == "E55 E99" and flat["d#s0000"].concept_id == "" and flat["d#s0000"].section_path == "1"


def test_issue_chunks(spark):
    pages = frame(spark, "issue int, outcome string, background array<string>, current array<string>, old array<string>", (7, "Agreed on E55.", ["Seen   in Mail", "new one"], ["p" * 1500, "q" * 1500], None), (8, None, None, None, None))
    register = frame(spark, "issue int, title string, status string", (7, "Types", "Done"))
    keys = frame(spark, "t string", ("> seen in\n> mail",)).select(X.paragraph_key("t").alias("key"))
    chunks, stats = R.issue_chunks(pages, register, keys, known())
    rows = {r.chunk_id: r for r in chunks.collect()}
    assert set(rows) == {"issue7#outcome", "issue7#background-s0000", "issue7#current-s0000", "issue7#current-s0001"}
    assert rows["issue7#outcome"].cite == "Issue 7 (Done): Types" and rows["issue7#outcome"].entities == ["E55"] and rows["issue7#background-s0000"].text == "new one"
    assert {r.issue: (r.kept, r.dropped, r.dropped_chars) for r in stats.collect()} == {7: (3, 1, 14)}


PARAGRAPHS = "doc string, pos int, style string, text string"


def test_meetings(spark):
    rows = [
        ("m1", 0, None, "Logo"), ("m1", 1, None, "The 40th joint meeting of the group"), ("m1", 2, None, "Some Museum, Town"), ("m1", 3, None, "9-10th December"), ("m1", 4, None, "2004 and more"), ("m1", 5, "Heading 1", "Welcome"), ("m1", 6, None, "short"),
        ("m1", 7, None, "Issue 172, 173: names"), ("m1", 8, None, "It is closed."), ("m1", 9, None, "204: done"), ("m1", 10, None, "999: unknown number"), ("m1", 11, None, "Issue 380"),
        ("m2", 0, None, "nothing much"), ("m2", 1, None, "w " * 4000),
    ]
    paragraphs, register = frame(spark, PARAGRAPHS, *rows), frame(spark, "issue int", (172,), (204,), (380,))
    files = frame(spark, "doc string, error string", ("m1", None), ("m2", None), ("m3", "KeyError: x"), ("m4", None))
    found = M.collect(paragraphs, files, register)
    heads = {r.doc: (r.title, r.date, r.venue) for r in M.headers(paragraphs).collect()}
    assert heads["m1"] == ("The 40th joint meeting of the group", "9-10th December 2004", "Some Museum, Town") and heads["m2"][1] is None
    chunks = {r.chunk_id: r for r in found["chunks"].collect()}
    assert "minutes:m1#s001" not in chunks  # a short section without issues
    assert chunks["minutes:m1#s002"].text == "Issue 172, 173: names\nIt is closed." and chunks["minutes:m1#s002"].issues == [172, 173]
    assert chunks["minutes:m1#s003"].text == "204: done\n999: unknown number" and "minutes:m1#s004" not in chunks
    assert sorted(k for k in chunks if "m2" in k) == ["minutes:m2#s000", "minutes:m2#s000-1"] and all(len(c.text) <= 6000 for c in chunks.values())
    assert chunks["minutes:m1#s002"].cite == "The 40th joint meeting of the group, 9-10th December 2004 — Issue 172, 173: names"
    links = {(r.issue, r.chunk_id) for r in found["issue_links"].collect()}
    assert links == {(172, "minutes:m1#s002"), (173, "minutes:m1#s002"), (204, "minutes:m1#s003"), (380, None)}
    assert {(r.doc, r.error) for r in found["unreadable"].collect()} == {("m3", "KeyError: x"), ("m4", "no text extracted")}
    assert found["duplicates"].count() == 0
    assert {r.heading for r in M.sections(paragraphs).where("doc = 'm1'").collect()} >= {"Preamble", "Issue 380"} and M.sections(paragraphs).where("heading = '204: done'").isEmpty()


def test_page_furniture(spark):
    pages = frame(spark, "d string, p int, t string", *[("a", k, f"Running  Head\ntext {k}\n{k}") for k in range(4)], ("b", 0, "x\n1"), ("b", 1, "x\n2"))
    kept = {(r.d, r.p, r.line) for r in C.without_furniture(pages, "d", "p", "t").collect()}
    assert kept == {("a", k, f"text {k}") for k in range(4)} | {("b", 0, "x"), ("b", 0, "1"), ("b", 1, "x"), ("b", 1, "2")}


def test_records_by_id(spark):
    messages = frame(spark, "id string, message_id string, subject string, body string", ("h1", "<1>", "s", "b1"), ("h2", "<2>", "s", "b2"))
    documents = frame(spark, "chunk_id string, heading string, text string, cite string", ("d#E55", "E55", "E55 Type\nIn first-order logic:\nE55(x)\n\nFull path:\nnone\nExamples:\nx", "c"),)
    got = {r.asked: (r.kind, r.id) for r in R.show(frame(spark, "asked string", ("h1",), (" <2> ",), ("d#E55",), ("gone",)), messages, documents).collect()}
    assert got == {"h1": ("message", "h1"), " <2> ": ("message", "h2"), "d#E55": ("document", "d#E55"), "gone": (None, None)}
    parts = R.declaration_parts(frame(spark, "concept string", ("E55",), ("E1",)), documents, "d").collect()
    assert [(r.concept, r.fol, r.full_path) for r in parts] == [("E55", "E55(x)", "none")]
    members = frame(spark, "thread string, id string, index int", ("t1", "h2", 1), ("t1", "h0", 2), ("t1", "h1", 3))
    assert [(r["index"], r.id) for r in R.read_threads(frame(spark, "thread string", ("t1",), ("t9",)), members, messages).collect()] == [(1, "h2"), (3, "h1")]
    none = "issue int, thread_count long, threads array<string>"
    issues = R.issue_records(frame(spark, "issue int", (1,), (2,), (3,)), frame(spark, none, (1, 2, ["a"])), frame(spark, "issue int, title string, status string", (1, "T", "Done")), frame(spark, "issue int, outcome string", (2, "agreed")), frame(spark, "issue int, meetings array<string>", (9, ["m"])))
    assert {r.issue: (r.title, r.thread_count, r.outcome, r.found) for r in issues.collect()} == {1: ("T", 2, None, True), 2: (None, 0, "agreed", True), 3: (None, 0, None, False)}


def test_quotes_in_sources(spark):
    messages = frame(spark, "id string, message_id string, body string", ("h1", "<1>", "First words here."), ("h2", "<2>", "It “is”  what it\nis , said one."), ("h3", "<3>", "it \"is\" what it is, once more and then quite another end of it"))
    members = frame(spark, "thread string, id string, index int", ("t1", "h1", 1), ("t1", "h2", 2), ("t1", "h3", 3))
    episodes = frame(spark, "episode_id string, thread string, ids array<string>", ("t1-e1", "t1", ["h3"]))
    documents = frame(spark, "chunk_id string, text string", ("d#s1", "a type is a kind"))
    asked = [("t1", 'it "is" what it is'), ("t1-e1", "WHAT IT IS"), ("d#s1", "type is a"), ("<2>", "said one"), ("h1", "second words here"), ("t1", "what it is, once more ... quite another end of it"), ("zz", "x")]
    got = {(r.source_id, r.phrase): r for r in Q.find_quotes(frame(spark, "source_id string, phrase string", *asked), members, episodes, messages, documents).collect()}
    assert [(got[a].source_kind, got[a].found, got[a].text_id, got[a]["index"]) for a in asked] == [("thread", True, "h2", 2), ("episode", True, "h3", 3), ("document", True, "d#s1", None), ("message", True, "h2", None), ("message", False, "h1", None), ("thread", True, "h3", 3), (None, False, None, None)]
    assert got[asked[0]].context == 'It "is" what it is'.replace("It", "**It", 1) + "**, said one." and 0.5 < got[asked[4]].score < 1
    with pytest.raises(ValueError):
        Q.find_quotes(frame(spark, "source_id string, phrase string", ("t1", " ")), members, episodes, messages, documents)


def test_spans_against_a_corpus(spark):
    units = frame(spark, "unit_id int, text string", (1, "The naïve  reader finds a long passage of many words , here."), (2, "Another unit: with quite other words in it — and dashes."))
    spans = {1: "the naïve reader finds a long passage", 2: "quite other words in it - and dashes", 3: "reader finds a long ... with quite other words", 4: "finds a long passage of many words that nobody wrote", 5: "nothing of the kind was ever written", 6: "ure", 7: "uqx", 8: "a long passage of ... never so said by anyone"}
    got = {r.span_id: (r.status, r.how, r.prefix_chars) for r in Q.verdicts(spark.createDataFrame(list(spans.items()), "span_id int, span string"), units).collect()}
    assert [got[k][:2] for k in (1, 2, 3)] == [("matched", "literal"), ("matched", "literal"), ("matched", "elided")]
    assert got[4] == ("partial", None, len("finds a long passage of many words")) and got[5][0] == "absent" and got[6][0] == "absent" and got[7][0] == "absent" and got[8][0] == "absent"
    assert Q.longest_prefix("abcd", "xabcx") == 3 and Q.longest_prefix("abc", "abc") == 3 and Q.longest_prefix("q", "abc") == 0 and Q.longest_prefix("", "abc") == 0
    assert Q.norm("ﬁne “a” — b ,") == 'fine "a" - b,' and Q.json_strings('{"a": ["x", {"b": "y"}], "c": 1, "d": "z"}') == ["x", "y", "z"]


def test_quotations(spark):
    text = """He said 'this is a span of more than five words' and "too short here" and (“a span in brackets that is long enough”) x'not one because it opens inside a word' ok."""
    got = frame(spark, "t string", (text,)).select(X.quotations("t").alias("q")).first().q
    assert got == ["this is a span of more than five words", "a span in brackets that is long enough"]


def test_episodes(spark):
    messages = frame(spark, "id string, date string, from_name string, from_email string, subject string, body string", ("a", "2004-02-01T00:00", "Ann", "a@x", "s", "one"), ("b", None, None, "b@x", "s", "two"), ("c", "2004-01-01T00:00", "Ann", "a@x", "s", "three"))
    members = frame(spark, "thread string, id string, index int", ("t1", "a", 1), ("t1", "gone", 2), ("t1", "b", 3), ("t1", "c", 4), ("t2", "a", 1), ("t3", "a", 1), ("t3", "b", 2))
    prompts = {r.thread: r.prompt for r in P.prompts(members, messages).collect()}
    assert set(prompts) == {"t1", "t3"} and prompts["t1"].startswith("### Thread t1 (3 messages)\n") and "--- [1]  | b@x | s ---\ntwo\n" in prompts["t1"]
    first = {"episodes": [{"topic": "T", "message_indexes": [1, 9], "outcome": "proposal", "entities": ["e55_Type", "LRM E2", "E99", "TC46"], "positions": [{"who": "Ann", "position": "for"}], "confidence": "high"}, {"topic": "U", "outcome": "decided", "confidence": "odd"}]}
    results = frame(spark, "shard string, thread string, result string", ("s0", "t1", json.dumps(first)), ("s0", "t9", json.dumps(first)), ("s1", "t2", "{broken"))
    ids = lambda *x: frame(spark, "id string", *[(i,) for i in x])
    found = P.collect(results, members, messages, ids("E55"), ids("E99"), frame(spark, "id string, mentions long", ("LRM-E2", 1)))
    rows = {r.episode_id: r for r in found["episodes"].collect()}
    one, two = rows["t1-e1"], rows["t1-e2"]
    assert (one.message_ids, one.outcome, one.coerced, one.participants) == (["b"], "informational", 1, ["b@x"])
    assert (one.entities, one.entities_historical, one.entities_extension, one.bogus) == (["E55"], ["E99"], ["LRM-E2"], ["TC46"])
    assert (two.message_ids, two.date_start, two.date_end, two.outcome, two.confidence, two.participants) == (["a", "b", "c"], "2004-01-01T00:00", "2004-02-01T00:00", "decided", "medium", ["Ann", "b@x"])
    assert {(r.thread, r.error) for r in found["errors"].collect()} == {("t9", "unknown thread"), ("t2", "unparseable")} and [r.thread for r in found["missing"].collect()] == ["t3"]
    index = {r.chunk_id: r for r in R.episode_rows(found["episodes"].withColumnRenamed("thread", "thread_id")).collect()}
    assert index["t1-e1"].body == "T\nAnn: for\nE55" and index["t1-e1"].entities == "E55 LRM-E2"
    assert [r.episode_id for r in P.held_in(found["episodes"], "E99").collect()] == ["t1-e1"]


def test_leading_ids(spark):
    rows = ["e22_Human_Made", " P14.1", "LRM E8 x", "TC46i", "E55F", "", None, "nothing"]
    got = [r.i for r in spark.createDataFrame([(x,) for x in rows], "t string").select(X.leading_id("t").alias("i")).collect()]
    assert got == ["E22", "P14", "LRM-E8", "TC46", "E55", None, None, None]


def test_listing_of_a_model(spark):
    listing = frame(spark, "source string, id string", ("base", "K1"), ("FieldWork", "X1"))
    assert Y.listing_of(listing, "fieldwork").first().id == "X1"
    with pytest.raises(ValueError, match="FieldWork, base"):
        Y.listing_of(listing, "none")


def test_document_blocks(spark):
    rows = [("d", 0, None, "cover"), ("d", 1, "Heading 1", "One"), ("d", 2, "Body", "text"), ("d", 3, "Heading2", "Sub"), ("d", 4, "Heading 2", "Sub b"), ("d", 5, "Class Label", "E55 Type"), ("d", 6, None, " note "), ("d", 7, "Table", "a | b"), ("d", 8, "Class Label", "no id"), ("d", 9, "Heading 1", "Tables"), ("d", 10, "Table", "skipped"), ("d", 11, None, "kept")]
    got = {(r.kind, r.concept_id, " > ".join(r.section_path), r.heading, r.text) for r in R.document_blocks(frame(spark, "doc_id string, pos int, style string, text string", *rows), ["Class Label"], ("Tables",)).collect()}
    assert got == {("narrative", None, "One", "One", "text"), ("declaration", "E55", "One > Sub b", "E55 Type", "note\na | b"), ("declaration", None, "One > Sub b", "no id", ""), ("narrative", None, "Tables", "Tables", "kept")}


def test_issue_pages(spark):
    html = '<div class="x field--name-field-outcome"><p>Agreed.</p></div><div class="field--name-field-old"><ul><li>one</li><li>two</li></ul></div>'
    slugs = {"outcome": "field-outcome", "background": "body", "current": "field-current", "old": "field-old", "references": "refs"}
    rows = {r.issue: r for r in R.issue_pages(frame(spark, "id int, html string", (7, html), (8, None)), slugs).collect()}
    assert (rows[7].outcome, rows[7].old, rows[7].background) == ("Agreed.", ["one", "two"], None) and rows[8].outcome is None
