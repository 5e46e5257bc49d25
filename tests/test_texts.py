import pytest
from pyspark.sql import functions as F

from threadloom.functions import chunking as K
from threadloom.functions import cleaning as L
from threadloom.functions import mail as M
from threadloom.operators import quotes as Q

FOOTER = ["_" * 40, "The mailing list", "list@example.org", "http://example.org/list"]


def strip(*lines):
    return L.strip_boilerplate(list(lines), "mailing list")


def test_footer_goes_at_any_depth():
    assert strip("hello", *FOOTER, "", "after") == (["hello", "", "after"], {"footer": 1})
    assert strip("hello", *["> > " + x for x in FOOTER], "after") == (["hello", "after"], {"footer": 1})


def test_rules_that_drop_to_the_end_are_guarded():
    assert strip("text", "_" * 30, "From: a", "b") == (["text"], {"outlook_separator": 1})
    assert strip("text", "--- Original Message ---", "b") == (["text"], {"original_message": 1})
    assert strip("text", "_" * 30, "Dr. A", "Institute") == (["text"], {"sig_block": 1})
    assert strip("--- Original Message ---", "b") == (["--- Original Message ---", "b"], {})
    assert strip("", "--- Original Message ---", "b", "--- Original Message ---", "c")[1] == {}  # what follows a spared rule isn't own content
    assert strip("-- ", "name") == ([], {"signature": 1})
    assert strip("--", "name") == (["--", "name"], {})


def test_quotations():
    long = "word " * 50
    kept, spans, counts = L.apply_quotes(["On Monday A. wrote:", "> a", "> b", "", long])
    assert kept == [long] and spans == [] and counts["single_block_quote"] == 1 and counts["attribution"] == 1
    kept, spans, counts = L.apply_quotes(["> a", "I agree"])
    assert kept == ["| a", "", "I agree"] and spans == [(0, 0)] and counts["thin_reply_context"] == 1
    kept, spans, counts = L.apply_quotes(["> a", "one", "B schrieb:", "> b", "> c", "two"])
    assert kept == ["| a", "one", "| b", "| c", "two"] and spans == [(0, 0), (2, 3)] and counts["interleaved_kept"] == 1
    assert L.apply_quotes(["| a | b |", "plain"]) == (["| a | b |", "plain"], [], {})
    assert len(L.apply_quotes([f"> {i}" for i in range(40)] + ["ok"])[0]) == 17


@pytest.mark.parametrize("text", ["", "short", "a\n\nb " * 900, "x" * 5000, ("word " * 300 + "\n\n") * 4, "tail " * 399 + "y" * 2100])
def test_chunks(text):
    chunks = K.recursive_split(text, 200, 40)
    assert all(0 < len(c) <= 200 and c in text for c in chunks)
    assert set(text.split()) <= {w for c in chunks for w in c.split()} or "x" * 200 in text or "y" * 200 in text


def test_sentences():
    assert K.sentence_pack("a. b.", 100) == ["a. b."]
    assert K.sentence_pack("One two. Three four. Five.", 20) == ["One two. Three four.", "Five."]
    assert K.sentence_pack("z" * 45, 20) == ["z" * 20, "z" * 20, "z" * 5]


def test_shards(spark):
    sizes = [(1, i, n) for i, n in enumerate([10, 10, 150, 10] + [1] * 12)]
    got = [r.shard for r in K.shard_numbers(spark.createDataFrame(sizes, "g int, i int, n long"), "g", "i", "n", 100, 10).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, *[2] * 9, *[3] * 3]


def test_decoding():
    assert M.decode("é".encode("cp1252"), "utf-8") == "é" and M.decode("é".encode(), "no-such") == "é" and M.decode(b"\x81", None) == "\x81"
    assert M.header("=?utf-8?B?w6k=?= x") == "é x" and M.header("=?bad?Q?x") == "=?bad?Q?x" and M.header(None) == ""


def test_html():
    assert M.html_text("<p>a &amp; b</p><script>x()</script><td>c<br>d") == "a & b c\nd"
    assert M.html_paragraphs("<div><p>one</p><ul><li>two <b>x</b></li></ul><table><tr><td>a</td><td>b</td></tr></table></div>") == ["one", "two x", "a | b"]
    assert M.html_paragraphs("no tags") == ["no tags"] and M.html_paragraphs("") == []
    assert M.html_fields('<div class="y field--name-a"><div><p>1</p><div>2</div></div></div><div class="field--name-b">3</div>') == {"a": ["1"], "b": ["3"]}
    assert M.strip_tags("a<br/>b &lt; c") == "a b < c"


def test_messages():
    raw = b"""From: =?utf-8?Q?J=C3=BCrgen?= <J@Example.org>\nTo: a@x.org, B <b@x.org>\nSubject: hi\nMessage-ID: <1@x>\nIn-Reply-To: <0@x>\nReferences: <r1@x> <r2@x>\nDate: Mon, 1 Mar 2004 10:00:00 +0100
Content-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>hyper</p>\n--B\nContent-Type: text/plain; charset=latin-1\nContent-Transfer-Encoding: 8bit\n\nplain \xe9\n--B\nContent-Type: text/plain; name="f.txt"\nContent-Disposition: attachment; filename="f.txt"\n\nattached\n--B--\n"""
    got = M.parse_message(raw)
    assert (got["from_name"], got["from_email"], got["to"], got["in_reply_to"], got["references"]) == ("Jürgen", "j@example.org", ["a@x.org", "b@x.org"], "<0@x>", ["<r1@x>", "<r2@x>"])
    assert got["body"].strip() == "plain é" and got["source"] == "plain" and got["date"].startswith("2004-03-01T10:00") and got["attachments"][0]["filename"] == "f.txt"
    assert M.parse_message(b"Content-Type: text/html\n\n<p>x</p>")["source"] == "html" and M.parse_message(b"")["source"] == "none" and M.iso_date("nonsense") is None


def test_quotations_are_found_but_not_paraphrases(spark):
    texts = spark.createDataFrame([(1, "They said: “It is what\n it is , after all these years of work.” Then more."), (2, "It was what it was, after all these years of work.")], "text_id int, text string")
    found = lambda p: {(r.text_id, r.start) for r in Q.contained(spark.createDataFrame([(1, p)], "phrase_id int, phrase string"), texts).collect()}
    assert found("it is what it is, after all these years of work.") == {(1, 13)}
    assert found('said: "it') == {(1, 6)} and found("it is what it was after all these years") == set() and found("") == set()
    assert Q.closest("abcdef", "xbcdx") == 0.6 and Q.closest("", "a") == 0.0


def test_closest_candidates_come_from_whole_texts(spark, sf):
    import re
    import unicodedata
    from difflib import SequenceMatcher

    from threadloom.plans import QUERIES

    docs = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen so it was a fine day"), (2, "far away a cat sat"), (3, "nothing"), (4, None)]
    items = [(7, "as i say so it was a fine day"), (8, "cat sat"), (9, "of a b c remarkable")]
    got = Q.candidates(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, phrase string")).collect()
    assert sorted(map(tuple, got)) == [(1, 7), (2, 8)]
    texts, phrases = ({r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()} for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))

    def features(text):
        w = re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c)))
        return {x for x in w if len(x) > 7} | {" ".join(w[k : k + 4]) for k in range(len(w) - 3)}

    f = {i: features(p) for i, p in phrases.items()}
    want = {(d, i) for d, t in texts.items() for i in (lambda own: [i for i in f if own & f[i]])(features(t))}
    rows = {(r.doc_id, r.item_id): r.score for r in QUERIES["x20_closest"](spark, sf).collect()}
    assert set(rows) == want and want
    norm = lambda s: re.sub(r"\s+([.,;:?!])", r"\1", re.sub(r"\s+", " ", s)).strip().lower()
    plain = [k for k in sorted(rows) if (texts[k[0]] + phrases[k[1]]).isascii()][:20]
    for d, i in plain:
        a, b = norm(phrases[i]), norm(texts[d])
        assert rows[d, i] == round(SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b)).size / len(a), 3)


def test_table_rows(spark):
    page = "<table><tr><th>No</th><th>Title</th></tr><tr><td><a href='/i/7'>Issue 7</a></td><td>On <b>types</b></td><td>Done</td></tr><tr></tr></table>"
    assert M.html_rows(page)[1] == [{"text": "Issue 7", "href": "/i/7"}, {"text": "On types", "href": None}, {"text": "Done", "href": None}]
    from threadloom.sources.files import register_rows

    rows = register_rows(spark.createDataFrame([(page,), (None,)], "html string"), "html", {"title": 1, "status": 2}).collect()
    assert [tuple(r) for r in rows] == [(7, "/i/7", "On types", "Done")]


def test_attributions_and_headers():
    assert L.is_attribution("On Monday A wrote:") and not L.is_attribution("He wrote a book") and not L.is_attribution("x" * 199 + " wrote:") and L.is_attribution("---- Original Message ----")
    assert M.header("=?utf-8?B?w6k=?=\n =?utf-8?B?w6k=?=") == "éé" and M.header("=?nosuch?Q?abc?=") == "=?nosuch?Q?abc?="


def test_line_forms(spark):
    rows = ["> > a", "| b", "| a | b |", "plain", ">", "   > x"]
    from threadloom.functions import text as X

    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], "t string").select(X.quote_depth("t"), X.unquoted("t"), X.is_quoted("t"), X.is_apparatus(F.array("t"), F.lit("References"))).collect()]
    assert got == [(2, "a", True, False), (1, "b", True, False), (1, "a | b |", False, False), (0, "plain", False, False), (1, "", True, False), (1, "x", True, False)]
