import io
import json
import zipfile

import pytest

from threadloom.sources import files as S
from threadloom.sources import graphs as R
from threadloom.streaming import first_messages, subject_sessions

TTL = """@prefix m: <http://m.example/> . @prefix ex: <http://e.example/> .
# a comment
ex:a a m:K1_Entity, m:K2 ; m:R1_has "say \\"hi\\"\\n"@en ; m:R2 [ a m:K3 ; m:R3 4.5 ] .
ex:b m:R4 (ex:a "x"^^m:t) ; m:R5 true ."""
XML = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xml:base="http://m.example/">
<rdfs:Class rdf:about="K2_Act"><rdfs:label xml:lang="en">Act</rdfs:label><rdfs:subClassOf rdf:resource="K1_Entity"/></rdfs:Class>
<rdf:Property rdf:about="R1_has"><rdfs:domain rdf:resource="K1_Entity"/><rdfs:range rdf:resource="K2_Act"/></rdf:Property></rdf:RDF>"""


def test_turtle():
    rows = set(R.turtle(TTL))
    assert ("http://e.example/a", R.RDF + "type", "http://m.example/K2", False) in rows
    assert ("http://e.example/a", "http://m.example/R1_has", 'say "hi"\n', True) in rows
    assert ("_:b1", "http://m.example/R3", "4.5", True) in rows and ("http://e.example/b", "http://m.example/R5", "true", True) in rows
    assert sum(p == R.RDF + "first" for _, p, _, _ in rows) == 2
    with pytest.raises(ValueError):
        list(R.turtle("no:prefix a b:c ."))
    assert list(R.turtle("<http://s> <http://p> <http://o> .\n<http://s> <http://p> \"l\" .")) == [("http://s", "http://p", "http://o", False), ("http://s", "http://p", "l", True)]


def test_rdf_files_and_schema(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    (tmp_path / "b.rdf").write_text(XML)
    (tmp_path / "bad.ttl").write_text("{{{")
    triples = R.read_rdf(spark, f"file://{tmp_path}/*").cache()
    assert [r.doc_id.rsplit("/")[-1] for r in triples.where("error IS NOT NULL").collect()] == ["bad.ttl"]
    got = {r.id: r for r in R.schema_rows(triples).collect()}
    assert got["K2"].label == "Act" and got["K2"].parents == ["K1"] and got["K2"].kind == "class"
    assert (got["R1"].kind, got["R1"].domain, got["R1"].range) == ("property", "K1", "K2")


def test_xml_links(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<set><item><in_class>K22: Thing</in_class><was_made_by><in_class>K12: Making</in_class><note>text<kind_of_note><in_class>K55: Kind</in_class></kind_of_note></note></was_made_by><note>a</note><note>b</note><size><value>3</value><unit><in_class>K58. Unit</in_class></unit></size></item><other/></set>")
    rows = {r.link: r for r in R.read_xml_links(spark, f"file://{tmp_path}/*.xml").collect()}
    made = rows["item[K22]/was_made_by"]
    assert (made.subject, made.name, made.object) == ("K22", "was made by", "K12") and not any(k.endswith(("value", "unit")) for k in rows)
    assert rows["item[K22]/was_made_by/note/kind_of_note"].via_property == "note" and "item[K22]/note[2]" in rows and rows["item[K22]/was_made_by/note"].object is None
    uses = {(r.path, r.id, r.label) for r in R.read_class_uses(spark, f"file://{tmp_path}/*.xml").collect()}
    assert uses == {("/item", "K22", "Thing"), ("/item/was_made_by", "K12", "Making"), ("/item/was_made_by/note/kind_of_note", "K55", "Kind"), ("/item/size/unit", "K58", "Unit")}


def test_json_ld():
    doc = {"@context": {"m": "http://m/", "made": {"@id": "m:R8_made"}, "@vocab": "http://v/"}, "@id": "m:a", "@type": "m:K12", "made": {"@id": "m:v", "@type": ["m:K22"], "label": {"@value": "Vase", "@language": "de"}}, "size": [3, {"@list": ["x", "y"]}]}
    rows = list(R.json_ld(json.dumps(doc)))
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    assert set(rows) == {("http://m/a", kind, "http://m/K12", False), ("http://m/a", "http://m/R8_made", "http://m/v", False), ("http://m/v", kind, "http://m/K22", False), ("http://m/v", "http://v/label", "Vase", True), ("http://m/a", "http://v/size", "3", True)} | {r for r in rows if r[0].startswith("_:j") or r[2].startswith("_:j")}
    assert next(r[2].language for r in rows if r[2] == "Vase") == "de"


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "m.docx").write_bytes(data.getvalue())
    assert [(r.pos, r.style, r.text) for r in R.read_docx(spark, f"file://{tmp_path}/*.docx").orderBy("pos").collect()] == [(0, "Heading1", "Title"), (1, "Table", "a | b")]


def test_missing_reads_as_empty_and_patterns_must_match(spark, tmp_path):
    assert S.read_or_empty(spark, f"file://{tmp_path}/none.json", "id string, title string").count() == 0
    (tmp_path / "r.json").write_text('{"id": "7", "title": "a"}\n{"id": "x", "title": "b"}\n')
    assert [r.id for r in S.read_register(spark, f"file://{tmp_path}/r.json", "id string, title string").collect()] == [7]
    with pytest.raises(FileNotFoundError):
        S.read_matching(spark, f"file://{tmp_path}/*.nothing")
    (tmp_path / "12.html").write_text("<p>x</p>")
    (tmp_path / "index.html").write_text("<p>y</p>")
    assert [(r.id, r.html) for r in S.read_pages(spark, f"file://{tmp_path}").collect()] == [(12, "<p>x</p>")]
    assert S.read_pages(spark, f"file://{tmp_path}/gone").count() == 0


def test_mbox(spark, tmp_path):
    (tmp_path / "a.mbox").write_bytes(b"From a@x Mon\nSubject: one\nMessage-ID: <1@x>\n\nbody\n>From here\n\nFrom b@x Tue\nSubject: two\nMessage-ID: <2@x>\n\nother\n")
    got = {r.message_id: r for r in S.read_mbox(spark, f"file://{tmp_path}/a.mbox").collect()}
    assert got["<1@x>"].subject == "one" and "From here" in got["<1@x>"].body and got["<2@x>"].body.strip() == "other"


def test_sinks_and_settings(spark, tmp_path):
    assert S.write_counted(spark.range(7), f"file://{tmp_path}/t") == 7
    sources = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")
    one, two = S.write_metadata(str(tmp_path / "m.json"), "s", sources), S.write_metadata(str(tmp_path / "n.json"), "s", sources.orderBy("path", ascending=False))
    assert one["source_sha256"] == two["source_sha256"] and json.loads((tmp_path / "m.json").read_text())["sources"] == 2
    assert S.provenance([one, {"name": "a"}]) == S.provenance([{"name": "a"}, one])
    (tmp_path / "c.json").write_text('{"list": {"chunk_size": 50, "unknown": 1}}')
    archive = S.load_archive(str(tmp_path / "c.json"), "list")
    assert archive.chunk_size == 50 and archive.chunk_overlap == 200
    with pytest.raises(KeyError, match="list"):
        S.load_archive(str(tmp_path / "c.json"), "other")


def test_streams(spark, tmp_path):
    rows = [("1", "a", "2024-01-01 00:00:00"), ("1", "a", "2024-01-02 00:00:00"), ("2", "a", "2024-01-20 00:00:00"), ("3", "a", "2024-05-01 00:00:00"), ("4", "b", "2024-06-20 00:00:00")]
    frame = spark.createDataFrame(rows, "message_id string, subject string, at string").selectExpr("message_id", "subject", "timestamp(at) AS ts")
    frame.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"file://{tmp_path}/in")
    out = {}
    for name, df in (("firsts", first_messages(stream)), ("sessions", subject_sessions(stream, ["subject"]))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c-{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        out[name] = spark.table(name).collect()
    assert sorted(r.message_id for r in out["firsts"]) == ["1", "2", "3", "4"]
    assert sorted(r.messages for r in out["sessions"] if r.subject == "a") == [1, 3]


def test_work_tables(spark):
    from threadloom.operators import worktables as W

    df = spark.createDataFrame([(i, f"k{i % 5}") for i in range(60)], "i int, k string").repartition(6)
    placed = W.global_rank(df, "place", "k", "i").collect()
    assert [r.place for r in sorted(placed, key=lambda r: (r.k, r.i))] == list(range(1, 61))
    assert W.spread(df.coalesce(1), "i").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    table = W.materialise(df, "t")
    assert table.count() == 60 and W.drop_work_tables(spark) >= 1 and W.drop_work_tables(spark) == 0
