"""Hierarchies at depth and breadth, and the sources of a model."""

import json

import pytest

from threadloom.operators import family as Y
from threadloom.operators import hierarchy as H
from threadloom.sources import graphs as G
from threadloom.sources import ontology as S


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def slow_distances(pairs):
    up = {}
    for c, p in pairs:
        up.setdefault(c, set()).add(p)
    out = {}
    for n in {x for e in pairs for x in e}:
        seen, now, hops = {n: 0}, {n}, 0
        while now:
            hops += 1
            now = {p for x in now for p in up.get(x, ())} - seen.keys()
            seen |= dict.fromkeys(now, hops)
        out |= {(n, a): d for a, d in seen.items()}
    return out


def slow_depths(pairs):
    up = {}
    for c, p in pairs:
        up.setdefault(c, set()).add(p)

    def deep(n, path):
        return max((1 + deep(p, path | {p}) for p in up.get(n, ()) if p not in path), default=0)

    return {n: deep(n, {n}) for n in {x for e in pairs for x in e}}


@pytest.mark.parametrize("name", ["chain", "diamonds", "cycle", "mixed", "self"])
def test_closures(spark, name):
    shapes = {
        "chain": [(f"n{k}", f"n{k + 1}") for k in range(100)],
        "diamonds": [(f"{s}{k}", f"{t}{k + 1}") for k in range(8) for s in "ab" for t in "ab"],
        "cycle": [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e"), ("e", "f")],
        "mixed": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "x"), ("x", "d"), ("d", "e"), ("p", "q"), ("q", "p"), ("r", "q"), ("q", "e")],
        "self": [("a", "a"), ("a", "b")],
    }
    pairs = shapes[name]
    frame = edges(spark, pairs)
    nodes = spark.createDataFrame([(x,) for x in sorted({x for e in pairs for x in e})], "id string")
    assert {(r.id, r.ancestor): r.distance for r in H.closure(nodes, frame).collect()} == slow_distances([e for e in pairs if e[0] != e[1]])
    assert {r.id: r.depth for r in H.depths(nodes, frame).collect()} == slow_depths([e for e in pairs if e[0] != e[1]])


def test_broad_closure(spark):
    leaves = spark.range(300_000).selectExpr("concat('n', id) AS child", "concat('g', id % 7) AS parent")
    whole = leaves.unionByName(edges(spark, [(f"g{k}", "top") for k in range(7)]))
    got = H.closure(leaves.selectExpr("child AS id"), whole)
    assert got.groupBy("distance").count().orderBy("distance").collect() == [(0, 300_000), (1, 300_000), (2, 300_000)]


def test_siblings(spark):
    frame = edges(spark, [("a", "p"), ("b", "p"), ("b", "q"), ("c", "q"), ("a", "p")])
    asked = spark.createDataFrame([("b",)], "id string")
    assert {tuple(r) for r in H.siblings(frame, asked).select("id", "sibling", "parent").collect()} == {("b", "a", "p"), ("b", "c", "q")}
    assert {tuple(r) for r in H.sibling_groups(frame).collect()} == {("a", "p", 1), ("b", "p", 1), ("b", "q", 1), ("c", "q", 1)}


SPEC = """<?xml version="1.0"?><ontology version="9" classes="{n}" properties="2">
<class id="K1"><fullName>K1 Entity</fullName><className>Entity</className><scopeNote>&lt;p&gt;All &amp;amp; any.&lt;/p&gt;</scopeNote><examples>&lt;ul&gt;&lt;li&gt;one&lt;/li&gt;&lt;li class="x"&gt;two &lt;b&gt;b&lt;/b&gt;&lt;/li&gt;&lt;/ul&gt;</examples></class>
<class id="K2"><className>Thing</className><subClassOf id="K1">K1 Entity</subClassOf></class>
<property id="R1"><directName>made</directName><inverseName>was made by</inverseName><domain id="K1">x</domain><range id="K2"/><quantification>many, necessary</quantification><propertyOfProperty id="R1.1"><labelText>in the way of</labelText><range id="K2"/></propertyOfProperty></property>
<property id="R2"><directName>noted</directName><domain id="K1"/><subPropertyOf id="R1">y</subPropertyOf></property></ontology>"""


def test_specification(spark, tmp_path):
    (tmp_path / "s.xml").write_text(SPEC.format(n=2))
    m, classes, properties = S.read_specification(spark, f"file://{tmp_path}/s.xml")
    c = {r.id: r for r in classes.collect()}
    assert (c["K1"].label, c["K1"].scope_note, c["K1"].examples, c["K2"].full_name, c["K2"].sub_class_of) == ("Entity", "All & any.", ["one", "two b"], "K2", ["K1"])
    p = {r.id: r for r in properties.collect()}
    assert (p["R1"].inverse, p["R1"].domain, p["R1"].range, p["R2"].inverse, p["R2"].range, p["R2"].sub_property_of) == ("was made by", "K1", "K2", None, None, ["R1"])
    assert [tuple(r) for r in m.qualifiers.collect()] == [("R1.1", "R1", "in the way of")] and [tuple(r) for r in m.class_edges.collect()] == [("K2", "K1")] and [tuple(r) for r in m.property_edges.collect()] == [("R2", "R1")]
    (tmp_path / "bad.xml").write_text(SPEC.format(n=3))
    with pytest.raises(ValueError, match="declares 3 classes, 2 were read"):
        S.read_specification(spark, f"file://{tmp_path}/bad.xml")


def test_family_collection(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"about": "x", "entries": {"F3": {"label": "Copy", "model": "lib", "kind": "class", "sub_class_of": ["K2"]}, "R7": {"label": "dug", "model": "dig", "kind": "property", "domain": "K1"}}}))
    rows = {r.id: r for r in S.read_family(spark, f"file://{tmp_path}/f.json").collect()}
    assert set(rows) == {"F3", "R7"} and rows["F3"].sub_class_of == ["K2"] and rows["R7"].domain == "K1" and rows["F3"].uri is None


RDFS_DOC = """@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix k: <http://k/> .
k:K1_Entity a rdfs:Class ; rdfs:label "Entity"@en .
k:K33_K41_Long_Name a owl:Class ; rdfs:label "Langer Name"@de, "Long Name"@en ; rdfs:subClassOf k:K2_Thing .
k:R1_made a rdf:Property ; rdfs:label "made" ; rdfs:domain k:K1_Entity ; rdfs:range k:K2_Thing .
k:R1a_made_about a owl:ObjectProperty ; rdfs:label "made about"@en ; rdfs:domain k:K1_Entity ; rdfs:range rdfs:Literal ; rdfs:subPropertyOf k:R1_made .
"""


def model_of(spark, tmp_path):
    (tmp_path / "s.xml").write_text(SPEC.format(n=2))
    return S.read_specification(spark, f"file://{tmp_path}/s.xml")[0]


def test_rdfs_additions(spark, tmp_path):
    m = model_of(spark, tmp_path)
    (tmp_path / "k.ttl").write_text(RDFS_DOC)
    classes, properties = S.rdfs_additions(G.read_rdf(spark, f"file://{tmp_path}/k.ttl"), m, "http://k/")
    assert [tuple(r) for r in classes.collect()] == [("K33_K41", "Long Name", ["K2"])]
    assert [tuple(r) for r in properties.collect()] == [("R1a", "made about", "K1", "K2", ["R1"])]  # a literal range is the parent's
    (tmp_path / "k.ttl").write_text(RDFS_DOC + 'k:K9_Other a rdfs:Class ; rdfs:label "Unlike"@en .\n')
    with pytest.raises(ValueError, match="K9_Other"):
        S.rdfs_additions(G.read_rdf(spark, f"file://{tmp_path}/k.ttl"), m, "http://k/")


def test_family_rdfs(spark, tmp_path):
    m = model_of(spark, tmp_path)
    (tmp_path / "Digs_v2.1.ttl").write_text("""@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix d: <http://digs/x/> . @prefix o: <http://digs/x/d1_pit/> .
d:D1_Pit a rdfs:Class ; rdfs:label "Pit"@en . d:D2_Layer a rdfs:Class ; rdfs:label "Layer" . d:D3_cut a <http://www.w3.org/1999/02/22-rdf-syntax-ns#Property> ; rdfs:label "cut"@en ; rdfs:domain d:K1_Entity ; rdfs:range rdfs:Literal . d:K2_Thing a rdfs:Class ; rdfs:label "Thing" . o:from a rdfs:Class ; rdfs:label "from" .""")
    known = spark.createDataFrame([("D1", "Pit", "Digs", "class", None, None, None), ("Z1", "Else", "Other", "class", "http://z/Z1_Else", None, None)], "id string, label string, model string, kind string, uri string, domain string, range string")
    rows = {r.id: r for r in S.family_rdfs(G.read_rdf(spark, f"file://{tmp_path}/Digs_v2.1.ttl"), m, known).collect()}
    assert set(rows) == {"D1", "Z1", "D2", "D3"} and rows["D1"].uri == "http://digs/x/D1_Pit" and rows["Z1"].uri == "http://z/Z1_Else"
    assert (rows["D2"].model, rows["D2"].kind, rows["D3"].kind, rows["D3"].domain, rows["D3"].range) == ("Digs", "class", "property", "K1", None)
    assert {r.ns for r in Y.owned_namespaces("http://k/", known.unionByName(spark.createDataFrame(list(rows.values()), known.schema))).collect()} == {"http://k/", "http://z/", "http://digs/x/"}


def test_newer_declarations(spark):
    rows = [("E99", "E99 Product Type", "E99 Product Type\nSubclass of:\n P7 x. E55 Type\n\nScope note:\nA note\nin two lines.\nExamples:\nx"), ("P200", "P200 names (is named in)", "Domain:\nE1 Entity\nRange:\nE55 Type\nSubproperty of:\nE90 Thing. P128i is borne by (bears): E18 Body\nQuantification:\nmany to many"), ("E1", "E1 Entity", "")]
    classes, properties = S.specification_additions(spark.createDataFrame(rows, "id string, heading string, text string"), spark.createDataFrame([("E1",)], "id string"))
    assert [tuple(r) for r in classes.collect()] == [("E99", "Product Type", ["E55"], "A note in two lines.")]
    (p,) = properties.collect()
    assert (p.id, p.direct, p.inverse, p.domain, p.range, p.sub_property_of, p.quantification) == ("P200", "names", "is named in", "E1", "E55", ["P128"], "many to many")


def test_documents_to_verdicts(spark, tmp_path):
    from threadloom.operators import validate as V

    m = model_of(spark, tmp_path)
    head = "@prefix k: <http://k/> . @prefix e: <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> .\n"
    docs = {"good": "e:a a k:K2_Thing . e:b a k:K2_Thing . e:a k:R1_made e:b .", "illegal": "e:a a k:K1_Entity . e:b a k:K1_Entity . e:a k:R1_made e:b .", "name": "e:a a k:K1_Entity . e:a k:R9_gone e:b .", "type": "e:a a k:K77_Gone .", "claim": "k:R1_made owl:inverseOf k:R2_noted .", "foreign": "e:a a k:K1_Entity . e:a e:other e:b .", "broken": "e:a a"}
    for name, text in docs.items():
        (tmp_path / f"{name}.ttl").write_text(head + text)
    owned = spark.createDataFrame([("http://k/",)], "ns string")
    kind, inverse = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2002/07/owl#inverseOf"
    rows = {r.doc_id.rsplit("/", 1)[-1].removesuffix(".ttl"): r for r in V.validate_rdf(G.read_rdf(spark, f"file://{tmp_path}/*.ttl"), m, owned, kind, inverse).collect()}
    assert {k: r.failed for k, r in rows.items()} == {"good": False, "illegal": True, "name": True, "type": True, "claim": True, "foreign": False, "broken": True}
    assert rows["good"].verdicts == {"ok": 1} and rows["name"].verdicts == {"unknown_name": 1} and rows["foreign"].verdicts == {"not_in_model": 1} and rows["broken"].error
    (tmp_path / "x1.xml").write_text("<set><item><in_class>K1: Entity</in_class><made><in_class>K2: Thing</in_class></made></item></set>")
    (tmp_path / "x2.xml").write_text("<set><item><in_class>K2: Other Name</in_class><gone><in_class>K1: Entity</in_class></gone></item></set>")
    path = f"file://{tmp_path}/x*.xml"
    found = {r.doc_id[-6:]: r for r in V.validate_xml(G.read_xml_links(spark, path), G.read_class_uses(spark, path), m, owned).collect()}
    assert not found["x1.xml"].failed and found["x2.xml"].failed and found["x2.xml"].labels == {"label_mismatch": 1} and found["x2.xml"].verdicts == {"unknown_name": 1}


def test_readers_by_suffix(spark, tmp_path):
    with pytest.raises(ValueError, match="no reader for 'pdf'"):
        G.read_documents(spark, [f"file://{tmp_path}/a.pdf"])
