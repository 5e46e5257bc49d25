"""Hierarchy and validation queries over a small invented model (diamond, shared label, inverse-named parent, extension class) and over star-schema edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import validate as V
from ..operators.worktables import materialise
from .common import query, sql_values, table, values

NS = "http://model.example/base/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
CLASSES = [("K1", "Entity", "base"), ("K2", "Occurrence", "base"), ("K5", "Happening", "base"), ("K7", "Deed", "base"), ("K12", "Making", "base"), ("K18", "Thing", "base"), ("K19", "Object", "base"), ("K22", "Artefact", "base"), ("K24", "Made Thing", "base"), ("K39", "Agent", "base"), ("K21", "Person", "base"), ("K55", "Kind", "base"), ("K53", "Spot", "base"), ("X1", "Dig", "fieldwork")]
EDGES = [("K2", "K1"), ("K5", "K2"), ("K7", "K5"), ("K12", "K7"), ("K18", "K1"), ("K19", "K18"), ("K24", "K18"), ("K22", "K19"), ("K22", "K24"), ("K39", "K1"), ("K21", "K39"), ("K21", "K19"), ("K55", "K1"), ("K53", "K1"), ("X1", "K7")]
PROPERTIES = [
    ("R1", "is named by", "names", "K1", "K55", "many to many", "base"), ("R2", "has kind", "is kind of", "K1", "K55", "many to many, necessary", "base"),
    ("R4", "was done by", "did", "K7", "K39", "many to many, necessary", "base"), ("R7", "took place at", "witnessed", "K5", "K53", "one to many, necessary, dependent", "base"),
    ("R8", "made", "was made by", "K12", "K24", "one to many, necessary", "base"), ("R9", "touched", "was touched in", "K7", "K18", "many to many", "base"),
    ("R10", "lies within", "contains", "K53", "K53", None, "base"), ("R11", "has note", None, "K1", None, None, "base"),
    ("R12", "knows", "knows", "K21", "K21", "many to many", "base"), ("R13", "contains", "lies in", "K19", "K19", "many to many", "base"), ("F1", "unearthed", "was unearthed by", "X1", "K19", "one to many, necessary", "fieldwork"),
]
PROPERTY_EDGES = [("R8", "R9"), ("R9", "R4i"), ("R7", "R1"), ("F1", "R9"), ("R4", "R2"), ("R13", "R10i")]
QUALIFIERS = [("R4.1", "R4", "in the role of"), ("R9.1", "R9", "in the way of")]
HISTORICAL = [("K99",), ("R3",)]
SHAPES = {"classes": "id string, label string, source string", "class_edges": "child string, parent string", "properties": "id string, direct string, inverse string, domain string, range string, quantification string, source string", "property_edges": "child string, parent string", "qualifiers": "id string, of_property string, label string"}
ROWS = {"classes": CLASSES, "class_edges": EDGES, "properties": PROPERTIES, "property_edges": PROPERTY_EDGES, "qualifiers": QUALIFIERS}
NAMES = {k: [x.split()[0] for x in v.split(", ")] for k, v in SHAPES.items()}
ONTO = "WITH RECURSIVE " + ", ".join(f"{k} AS (SELECT * FROM {sql_values(r, *[n if n != 'range' else 'range' for n in NAMES[k]])})" for k, r in ROWS.items())
UP = ", up(id, ancestor, hops) AS (SELECT id, id, 0 FROM classes UNION ALL SELECT up.id, e.parent, hops + 1 FROM up JOIN class_edges e ON e.child = up.ancestor), clo AS (SELECT id, ancestor, min(hops) AS distance FROM up GROUP BY ALL)"
DEEP = ", pe AS (SELECT child, CASE WHEN parent IN (SELECT id FROM properties) THEN parent ELSE left(parent, length(parent) - 1) END AS parent FROM property_edges), pup(id, ancestor, hops) AS (SELECT id, id, 0 FROM properties UNION ALL SELECT pup.id, e.parent, hops + 1 FROM pup JOIN pe e ON e.child = pup.ancestor), deep AS (SELECT p.*, d.depth FROM properties p JOIN (SELECT id, max(hops) AS depth FROM pup GROUP BY id) d USING (id))"
BASE = ONTO + UP + DEEP


def model(spark) -> H.Model:
    return H.Model(**{k: values(spark, SHAPES[k], ROWS[k]) for k in ROWS})


STAR = "edges AS (SELECT concat('c', c_custkey) AS child, concat('n', c_nationkey) AS parent FROM customer UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation UNION ALL SELECT concat('r', r_regionkey), 'world' FROM region)"


def star(spark, sf):
    edge = lambda t, a, ak, b, bk: table(spark, sf, t).select(F.concat(F.lit(a), F.col(ak).cast("string")).alias("child"), F.concat(F.lit(b), F.col(bk).cast("string")).alias("parent"))
    top = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("world").alias("parent"))
    return edge("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(top)


@query(f"WITH RECURSIVE {STAR}, up(id, ancestor, hops) AS (SELECT DISTINCT child, child, 0 FROM edges UNION ALL SELECT up.id, e.parent, hops + 1 FROM up JOIN edges e ON e.child = up.ancestor) SELECT id, ancestor, min(hops) AS distance FROM up GROUP BY ALL")
def g1_ancestors(spark, sf):
    edges = materialise(star(spark, sf), "edges")  # a recursion reads them once a level
    return H.closure(edges.select(F.col("child").alias("id")), edges)


@query(BASE + " SELECT id, ancestor, distance FROM clo")
def g2_distance(spark, sf):
    m = model(spark)
    return H.closure(m.classes, m.class_edges)


@query(BASE + " SELECT id, depth FROM deep")
def g3_depth(spark, sf):
    return H.property_depths(model(spark))


ASKED = [("R1",), ("R1i",), ("R10i",), ("R99i",), ("R11i",), ("i",)]


@query(BASE + f", a AS (SELECT * FROM {sql_values(ASKED, 'id')}) SELECT a.id, coalesce(p.id, q.id) AS base, p.id IS NULL AND q.id IS NOT NULL AS inverse FROM a LEFT JOIN properties p ON p.id = a.id LEFT JOIN properties q ON p.id IS NULL AND a.id LIKE '%i' AND q.id = left(a.id, length(a.id) - 1)")
def g4_resolve(spark, sf):
    return H.resolved(values(spark, "id string", ASKED), model(spark).properties)


@query(BASE + ", x AS (SELECT c.id AS class_id, 'outgoing' AS direction, d.id AS property_id, depth FROM clo c JOIN deep d ON c.ancestor = d.domain UNION ALL SELECT c.id, 'incoming', d.id, depth FROM clo c JOIN deep d ON c.ancestor = d.range) SELECT class_id, direction, property_id, row_number() OVER (PARTITION BY class_id, direction ORDER BY depth DESC, property_id) AS place FROM x")
def g5_closure(spark, sf):
    return H.property_closure(model(spark))


APPLICABLE = ", ap AS (SELECT c.id AS class_id, d.id AS property_id, 'outgoing' AS direction, ancestor AS via, distance, coalesce(contains(quantification, 'necessary'), false) AS required, depth FROM clo c JOIN deep d ON c.ancestor = d.domain UNION ALL SELECT c.id, d.id, 'incoming', ancestor, distance, false, depth FROM clo c JOIN deep d ON c.ancestor = d.range)"


@query(BASE + APPLICABLE + " SELECT * EXCLUDE (depth), row_number() OVER (PARTITION BY class_id, direction ORDER BY distance, depth DESC, property_id) AS place FROM ap")
def g6_applicable(spark, sf):
    return H.applicable(model(spark))


@query(BASE + APPLICABLE + " SELECT class_id, property_id, via FROM ap WHERE required")
def g7_required(spark, sf):
    return H.applicable(model(spark)).where("required").select("class_id", "property_id", "via")


@query(BASE + ", f AS (SELECT a.id AS subject, b.id AS object, d.id AS property_id, a.distance + b.distance AS generality, depth FROM clo a JOIN deep d ON a.ancestor = d.domain JOIN clo b ON b.ancestor = d.range) SELECT subject, object, property_id, generality, generality = 0 AS exact, row_number() OVER (PARTITION BY subject, object ORDER BY generality, depth DESC, property_id) AS place FROM f")
def g8_connect(spark, sf):
    m = model(spark)
    ids = m.classes.select(F.col("id").alias("subject"))
    return H.connecting(m, ids.crossJoin(ids.select(F.col("subject").alias("object"))))


@query(BASE + " SELECT id, label, array_to_string(coalesce((SELECT list_sort(list(DISTINCT parent)) FROM class_edges WHERE child = id), []), ',') AS parents, array_to_string(coalesce((SELECT list_sort(list(DISTINCT child)) FROM class_edges WHERE parent = id), []), ',') AS children FROM classes")
def g10_skeleton(spark, sf):
    return H.skeleton(model(spark)).select("id", "label", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


@query(BASE + f""", e AS (SELECT source, id, 'class' AS kind, label FROM classes UNION ALL SELECT source, id, 'property', direct FROM properties UNION ALL SELECT 'base', id, 'qualifier', label FROM qualifiers UNION ALL SELECT 'historical', id, 'historical', NULL FROM {sql_values(HISTORICAL, 'id')})
    SELECT source, id, kind, label, row_number() OVER (ORDER BY CASE source WHEN 'base' THEN 0 WHEN 'historical' THEN 2 ELSE 1 END, source, CASE kind WHEN 'class' THEN 0 ELSE 1 END, regexp_extract(id, '^([A-Z]+)', 1), coalesce(TRY_CAST(regexp_extract(id, '^[A-Z]+(\\d+)', 1) AS INT), 0), coalesce(TRY_CAST(regexp_extract(id, '\\.(\\d+)$', 1) AS INT), 0), id) AS place FROM e""")
def g11_listing(spark, sf):
    return H.listing(model(spark), values(spark, "id string", HISTORICAL))


@query(f"WITH {STAR} SELECT DISTINCT a.child AS id, b.child AS sibling, a.parent FROM edges a JOIN edges b ON a.parent = b.parent AND a.child <> b.child WHERE a.child LIKE 'n%' OR a.child LIKE 'r%'")
def g12_siblings(spark, sf):
    """Siblings of every nation and region."""
    edges = star(spark, sf)
    return H.siblings(edges, edges.select(F.col("child").alias("id")).where("id LIKE 'n%' OR id LIKE 'r%'"))


@query(f"WITH {STAR}, e AS (SELECT DISTINCT * FROM edges) SELECT child AS id, parent, count(*) OVER (PARTITION BY parent) - 1 AS siblings FROM e")
def g12_sibling_groups(spark, sf):
    return H.sibling_groups(star(spark, sf))


@query(f"WITH {STAR}, d AS (SELECT child AS id, CASE left(child, 1) WHEN 'r' THEN 1 WHEN 'n' THEN 2 ELSE 3 END AS depth FROM edges) SELECT DISTINCT id, depth FROM d")
def g3_star_depth(spark, sf):
    edges = materialise(star(spark, sf), "edges")
    return H.depths(edges.select(F.col("child").alias("id")), edges)


CONCEPTS = [("K22",), ("r8",), ("Contains",), ("knows",), ("R4.1",), ("nothing",), ("artefact",)]


@query(BASE + f""", n AS (SELECT 0 AS prio, id, label FROM classes UNION ALL SELECT 1, id, direct FROM properties UNION ALL SELECT 2, id, label FROM qualifiers UNION ALL SELECT 1, id, inverse FROM properties WHERE inverse IS NOT NULL), a AS (SELECT * FROM {sql_values(CONCEPTS, 'asked')}),
    b AS (SELECT asked, 0 AS how, prio, id FROM a JOIN n ON upper(asked) = id UNION SELECT asked, 1, prio, id FROM a JOIN n ON lower(asked) = lower(label)), m AS (SELECT *, min(how) OVER (PARTITION BY asked) AS best FROM b)
    SELECT asked, arg_min(id, {{'p': prio, 'i': id}}) AS id, array_to_string(list_sort(list(DISTINCT id)), ',') AS matches FROM m WHERE how = best GROUP BY asked""")
def g13_concept(spark, sf):
    """A concept by id in any case, else by label in any direction, with all that share the label."""
    return H.find_concepts(model(spark), values(spark, "asked string", CONCEPTS))


URIS = [(NS + "K22_Artefact",), (NS + "k22",), ("m:R8_made",), ("R8i_was_made_by",), (NS + "R99_gone",), ("http://other.example/made",), (NS + "K24_Made_Thing",), ("R11i",)]
INDEX = r""", ui AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, id) AS n FROM (
    SELECT id, false AS inverse, 'class' AS kind, lower(unnest([id, concat(id, '_', regexp_replace(label, '\s+', '_', 'g'))])) AS key, 0 AS prio FROM classes
    UNION ALL SELECT id, false, 'property', lower(unnest([id, concat(id, '_', regexp_replace(direct, '\s+', '_', 'g'))])), 1 FROM properties
    UNION ALL SELECT id, true, 'property', lower(unnest([concat(id, 'i'), concat(id, 'i_', regexp_replace(inverse, '\s+', '_', 'g'))])), 2 FROM properties WHERE inverse IS NOT NULL)) WHERE n = 1)"""


@query(BASE + INDEX + f", u AS (SELECT * FROM {sql_values(URIS, 'uri')}) SELECT uri, id, coalesce(inverse, false) AS inverse, kind FROM u LEFT JOIN ui ON ui.key = lower(regexp_extract(uri, '([^/#:]+)/?$', 1))")
def g15_resolve_uri(spark, sf):
    return V.resolve_uris(model(spark), values(spark, "uri string", URIS)).withColumn("inverse", F.coalesce("inverse", F.lit(False)))


PROP_NAMES = [("R4",), ("r4i",), ("R11i",), ("R4.1",), ("contains",), ("knows",), ("has kind",), ("R8 made",), (NS + "R8_made",), ("Is Kind Of",), ("in the role of",), ("gone",)]
CAND = BASE + r""", nm AS (SELECT DISTINCT name FROM {links}), lab AS (SELECT id, direct AS l, false AS inverse, false AS q FROM properties UNION ALL SELECT id, inverse, true, false FROM properties WHERE inverse IS NOT NULL UNION ALL SELECT id, label, false, true FROM qualifiers),
    ident AS (SELECT id AS u, id, false AS inverse, false AS q, 1 AS k FROM properties UNION ALL SELECT concat(id, 'i'), id, true, false, 2 FROM properties WHERE inverse IS NOT NULL UNION ALL SELECT id, id, false, true, 0 FROM qualifiers),
    cx AS (SELECT name, id, inverse, q, k FROM nm JOIN ident ON upper(trim(name)) = upper(u)
      UNION ALL SELECT name, id, inverse, q, 3 FROM nm JOIN ident ON upper(u) = upper(regexp_extract(regexp_extract(name, '([^/#]+)/?$', 1), '^([A-Za-z]+\d+(?:\.\d+)?i?)(?:_|$)', 1))
      UNION ALL SELECT name, id, inverse, q, 4 FROM nm JOIN ident ON k > 0 AND upper(u) = upper(regexp_extract(name, '^\s*([A-Za-z]+\d+i?)[ _]\S', 1))
      UNION ALL SELECT name, id, inverse, q, 5 FROM nm JOIN lab ON trim(regexp_replace(lower(l), '[^a-z0-9]+', '_', 'g'), '_') = trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_')),
    cand AS (SELECT DISTINCT name, id AS property_id, inverse, q AS qualifier FROM (SELECT *, min(k) OVER (PARTITION BY name) AS best FROM cx) WHERE k = best)"""


@query(CAND.replace("{links}", sql_values(PROP_NAMES, "name")) + " SELECT * FROM cand")
def g17_candidates(spark, sf):
    return V.candidates(model(spark), values(spark, "name string", PROP_NAMES))


# link, subject, subject_types, name, object, object_types, predicate_uri, via_property, path
LINKS = [
    ("l1", "K12", None, "R8", "K22", None, None, None, "d1/a"), ("l2", "K22", None, "R8", "K12", None, None, None, "d1/b"), ("l3", "k22", None, "was made by", "K12", None, None, None, "d1/b"),
    ("l4", "K19", None, "contains", "K22", None, None, None, "d1/c"), ("l5", "K21", None, "knows", "K21", None, None, None, "d1/d"), ("l6", "K7", None, "R4.1", "K55", None, None, None, "d1/e"),
    ("l7", "K77", None, "R4", "K39", None, None, None, "d2/a"), ("l8", "K7", None, "gone", "K39", None, None, None, "d2/a"), ("l9", None, None, "R4", "K39", None, None, None, "d2/b"),
    ("l10", "K7", None, "R4", None, None, None, None, "d2/c"), ("l11", "K7", None, "R4", "K39", None, None, "has note", "d2/c"), ("l12", "K1", None, "made it", "K1", None, "http://other.example/made", None, "d3/a"),
    ("l13", "K1", None, "R77_gone", "K1", None, NS + "R77_gone", None, "d3/b"), ("l14", "K1", ["K53", "K5"], "R7", "K53", ["K55", "K53"], NS + "R7_took_place_at", None, "d3/c"), ("l15", "X1", None, "F1", "K22", None, None, None, "d3/d"),
    ("l16", "K1", None, "R11", "K77", None, None, None, "d4/a"), ("l17", "K1", ["K53", "K5"], "R8", None, None, None, None, "d4/b"),
]
LINK_SHAPE = "link string, subject string, subject_types array<string>, name string, object string, object_types array<string>, predicate_uri string, via_property string, path string"
LINK_NAMES = [x.split()[0] for x in LINK_SHAPE.split(", ")]
OWNED = [(NS,)]
SQL_LINKS = "(SELECT link, subject, subject_types::VARCHAR[] AS subject_types, name, object, object_types::VARCHAR[] AS object_types, predicate_uri, via_property, path FROM " + sql_values(LINKS, *LINK_NAMES) + ")"
READ = CAND.replace("{links}", SQL_LINKS) + f""", li AS (SELECT * FROM {SQL_LINKS}), st AS (SELECT link, unnest(CASE WHEN len(subject_types) > 0 THEN subject_types ELSE [subject] END) AS s, unnest(range(greatest(1, coalesce(len(subject_types), 0)))) AS spos FROM li),
    ob AS (SELECT link, unnest(CASE WHEN len(object_types) > 0 THEN object_types ELSE [object] END) AS o, unnest(range(greatest(1, coalesce(len(object_types), 0)))) AS opos FROM li),
    pr AS (SELECT link, name, spos, opos, upper(trim(s)) AS s, upper(trim(o)) AS o FROM li JOIN st USING (link) JOIN ob USING (link)),
    rd AS (SELECT pr.*, coalesce(s IN (SELECT id FROM classes), false) AND (o IS NULL OR o IN (SELECT id FROM classes)) AS known, property_id, qualifier, concat(property_id, CASE WHEN c.inverse THEN 'i' ELSE '' END) AS reading,
      CASE WHEN c.inverse THEN p.range ELSE p.domain END AS ns, CASE WHEN c.inverse THEN p.domain ELSE p.range END AS no FROM pr LEFT JOIN cand c USING (name) LEFT JOIN properties p ON p.id = c.property_id),
    lg AS (SELECT *, CASE WHEN NOT known OR property_id IS NULL THEN false WHEN qualifier THEN NULL ELSE (ns IS NULL OR EXISTS (SELECT 1 FROM clo WHERE clo.id = s AND ancestor = ns)) AND (o IS NULL OR no IS NULL OR EXISTS (SELECT 1 FROM clo WHERE clo.id = o AND ancestor = no)) END AS legal FROM rd)"""
SPOKEN = READ + """, pa AS (SELECT link, spos, opos, coalesce(bool_or(legal), false) AS legal, list_sort(list(DISTINCT reading) FILTER (legal)) AS fits, bool_or(qualifier AND known) AS qualified, count(property_id) AS n, bool_or(known) AS known FROM lg GROUP BY ALL),
    sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY NOT legal, spos, opos) AS r FROM pa) WHERE r = 1),
    vd AS (SELECT li.link, li.path, CASE WHEN predicate_uri IS NOT NULL AND n = 0 THEN CASE WHEN regexp_extract(predicate_uri, '^(.*[/#])[^/#]*$', 1) = '""" + NS + """' THEN 'unknown_name' ELSE 'not_in_model' END WHEN subject IS NULL THEN 'unchecked' WHEN via_property IS NOT NULL THEN 'attached_to_property'
      WHEN legal AND len(fits) > 1 THEN 'ambiguous' WHEN legal THEN CASE WHEN object IS NOT NULL THEN 'ok' ELSE 'ok_literal' END WHEN known AND qualified THEN 'not_a_class_link' WHEN NOT known THEN 'unknown_class' WHEN n = 0 THEN 'unknown_name' ELSE 'illegal' END AS verdict,
      CASE WHEN legal AND len(fits) = 1 THEN fits[1] END AS resolved FROM li JOIN sp USING (link))"""


def links(spark):
    return values(spark, LINK_SHAPE, LINKS)


@query(READ + " SELECT link, coalesce(bool_or(legal), false) AS legal, CASE WHEN count(DISTINCT reading) FILTER (legal) = 1 THEN min(reading) FILTER (legal) END AS resolved, CASE WHEN count(DISTINCT reading) FILTER (legal) > 1 THEN array_to_string(list_sort(list(DISTINCT reading) FILTER (legal)), ',') END AS ambiguous FROM lg GROUP BY link")
def g18_validate_link(spark, sf):
    return V.link_verdicts(model(spark), links(spark)).withColumn("ambiguous", F.array_join("ambiguous", ","))


@query(SPOKEN + " SELECT link, verdict, resolved FROM vd")
def g19_validate_document(spark, sf):
    return V.document_verdicts(model(spark), links(spark), values(spark, "ns string", OWNED))


@query(SPOKEN + " SELECT verdict, count(*) AS n FROM vd GROUP BY verdict")
def a11_verdict_counts(spark, sf):
    return g19_validate_document(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(SPOKEN + " SELECT string_split(path, '/')[1] AS doc, bool_or(verdict IN ('illegal', 'unknown_name', 'unknown_class', 'not_a_class_link')) AS failed FROM vd GROUP BY 1")
def g25_pass_fail(spark, sf):
    found = g19_validate_document(spark, sf).join(links(spark).select("link", F.split("path", "/")[0].alias("doc")), "link")
    return found.groupBy("doc").agg(F.bool_or(F.col("verdict").isin(*V.FAILING)).alias("failed"))


USES = [("K22: Artefact", "a", "K22", "Artefact"), ("K22: Man-Made", "b", "K22", "Man-Made"), ("K22: Man-Made", "b", "K22", "Man-Made"), ("K404", "c", "K404", None), ("", "d", None, None), ("R8: made", "e", "R8", "MADE"), ("K1", "f", "K1", None)]


@query(ONTO + f", u AS (SELECT DISTINCT * FROM {sql_values(USES, 'raw', 'path', 'id', 'label')}), n AS (SELECT id, label AS current FROM classes UNION ALL SELECT id, direct FROM properties), f AS (SELECT raw, path, CASE WHEN coalesce(u.id, '') = '' THEN 'malformed' WHEN n.id IS NULL THEN 'unknown_class' WHEN coalesce(label, '') <> '' AND lower(label) <> lower(current) THEN 'label_mismatch' END AS verdict FROM u LEFT JOIN n ON u.id = n.id) SELECT * FROM f WHERE verdict IS NOT NULL")
def g20_labels(spark, sf):
    return V.label_findings(model(spark), values(spark, "raw string, path string, id string, label string", USES))


COMPLETE = READ + """, nodes AS (SELECT DISTINCT path, unnest(CASE WHEN len(subject_types) > 0 THEN subject_types ELSE [subject] END) AS class_id FROM li WHERE subject IS NOT NULL), stated AS (SELECT DISTINCT path, property_id FROM li JOIN cand USING (name) WHERE subject IS NOT NULL),
    req AS (SELECT DISTINCT clo.id AS class_id, p.id AS property_id FROM clo JOIN properties p ON p.domain = ancestor WHERE contains(quantification, 'necessary')), ask AS (SELECT n.path, n.class_id, r.property_id, s.path IS NULL AS miss FROM nodes n JOIN req r USING (class_id) LEFT JOIN stated s ON s.path = n.path AND s.property_id = r.property_id),
    cp AS (SELECT class_id, property_id, count_if(miss) AS missing, count(*) AS instances FROM ask GROUP BY ALL HAVING count_if(miss) > 0)"""


@query(COMPLETE + " SELECT * FROM cp")
def a12_completeness(spark, sf):
    return V.completeness(model(spark), links(spark))


@query(COMPLETE + " SELECT property_id, sum(missing) AS missing, sum(instances) AS instances, array_to_string(list_sort(list(DISTINCT class_id)), ',') AS classes FROM cp WHERE missing = instances GROUP BY property_id")
def a13_wholly_absent(spark, sf):
    gone = V.completeness(model(spark), links(spark)).where("missing = instances")
    return gone.groupBy("property_id").agg(F.sum("missing").alias("missing"), F.sum("instances").alias("instances"), F.array_join(F.array_sort(F.collect_set("class_id")), ",").alias("classes"))


TRIPLES = [
    ("t1", "ex:m", TYPE, NS + "K12_Making", False), ("t1", "ex:v", TYPE, NS + "K22_Artefact", False), ("t1", "ex:m", NS + "R8_made", "ex:v", False), ("t1", "ex:v", "ex:madeIn", "ex:m", False), ("t1", "ex:v", NS + "R11_has_note", "a vase", True),
    ("t1", "ex:p", NS + "R2_has_kind", "ex:k", False), ("t2", "ex:x", TYPE, NS + "R8_made", False), ("t2", "ex:y", TYPE, NS + "K404_Gone", False), ("t2", "ex:z", TYPE, "http://other.example/Thing", False), ("t2", "ex:z", "http://www.w3.org/2000/01/rdf-schema#label", "z", True), ("t2", "ex:d", TYPE, NS + "K7", False), ("t2", "ex:d", NS + "R8_made", "ex:z", False),
]
TRIPLE_SHAPE = "doc_id string, subject string, predicate string, object string, object_is_literal boolean"
CLAIMS = [("ex:madeIn", NS + "R8_made"), (NS + "R8_made", NS + "R8i_was_made_by"), (NS + "R8_made", NS + "R8_made"), (NS + "R8_made", NS + "R4_was_done_by"), (NS + "K22_Artefact", "ex:q"), ("ex:a", "ex:b")]
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
SQL_T = "(SELECT * FROM " + sql_values(TRIPLES, "doc_id", "subject", "predicate", "object", "lit") + ")"
LOCAL = "lower(regexp_extract({}, '([^/#:]+)/?$', 1))"


@query(BASE + INDEX + f""", t AS (SELECT * FROM {SQL_T}), ty AS (SELECT doc_id, subject, list_sort(list(DISTINCT id)) AS types FROM t JOIN ui ON key = {LOCAL.format('object')} WHERE predicate = '{TYPE}' AND kind = 'class' GROUP BY ALL),
    r AS (SELECT doc_id, CASE WHEN predicate = 'ex:madeIn' THEN object ELSE subject END AS path, CASE WHEN predicate = 'ex:madeIn' THEN '{NS}R8_made' ELSE predicate END AS predicate_uri, CASE WHEN predicate = 'ex:madeIn' THEN subject WHEN NOT lit THEN object END AS target FROM t WHERE predicate NOT IN ('{TYPE}', '{LABEL}'))
    SELECT r.doc_id, path, predicate_uri, array_to_string(s.types, ',') AS subject_types, array_to_string(o.types, ',') AS object_types FROM r LEFT JOIN ty s ON s.doc_id = r.doc_id AND s.subject = path LEFT JOIN ty o ON o.doc_id = r.doc_id AND o.subject = target""")
def g22_links(spark, sf):
    found = V.rdf_links(values(spark, TRIPLE_SHAPE, TRIPLES), values(spark, "subject string, object string", CLAIMS), model(spark), TYPE, (LABEL,))
    return found.select("doc_id", "path", "predicate_uri", F.array_join("subject_types", ",").alias("subject_types"), F.array_join("object_types", ",").alias("object_types"))


@query(BASE + INDEX + f", t AS (SELECT * FROM {SQL_T} WHERE predicate = '{TYPE}'), f AS (SELECT subject AS path, object AS raw, CASE WHEN kind = 'class' THEN NULL WHEN kind = 'property' THEN 'not_a_class' WHEN object LIKE '{NS}%' THEN 'unknown_class' ELSE 'not_in_model' END AS verdict FROM t LEFT JOIN ui ON key = {LOCAL.format('object')}) SELECT * FROM f WHERE verdict IS NOT NULL")
def g23_types(spark, sf):
    uses = values(spark, TRIPLE_SHAPE, TRIPLES).where(F.col("predicate") == TYPE).select(F.col("subject").alias("path"), F.col("object").alias("uri"))
    return V.type_findings(model(spark), uses, values(spark, "ns string", OWNED))


@query(BASE + INDEX + f", c AS (SELECT * FROM {sql_values(CLAIMS, 'subject', 'object')}) SELECT subject, object, CASE WHEN l.id IS NULL AND r.id IS NULL THEN 'foreign' WHEN 'class' IN (l.kind, r.kind) THEN 'not_invertible' WHEN l.id IS NULL OR r.id IS NULL THEN 'bridge' WHEN l.id <> r.id OR l.inverse = r.inverse THEN 'contradicted' ELSE 'ok' END AS verdict FROM c LEFT JOIN ui l ON l.key = {LOCAL.format('subject')} LEFT JOIN ui r ON r.key = {LOCAL.format('object')}")
def g24_inverse(spark, sf):
    return V.inverse_claims(model(spark), values(spark, "subject string, object string", CLAIMS))


OVERRIDES = [("Brand#1", "given"), ("Other", "given")]


@query(f"""WITH m AS (SELECT left(p_brand, 7) AS prefix, p_type AS model FROM part), c AS (SELECT prefix, model, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT prefix, model FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, model) AS r FROM c) WHERE r = 1),
    o AS (SELECT * FROM {sql_values(OVERRIDES, 'prefix', 'given')}) SELECT prefix, coalesce(given, model) AS model FROM b FULL JOIN o USING (prefix)""")
def g26_family_owner(spark, sf):
    members = table(spark, sf, "part").select(F.substring("p_brand", 1, 7).alias("prefix"), F.col("p_type").alias("model"))
    return H.family_owner(members, values(spark, "prefix string, model string", OVERRIDES))


OWNERS = [("E", "base"), ("EX", "ext"), ("EXT", "other"), ("D", "dig")]
IDS = [("E5",), ("EX7",), ("EXT12",), ("EX100",), ("D99",), ("DX1",), ("E5a",), ("Q1",)]


@query(f"WITH i AS (SELECT * FROM {sql_values(IDS, 'id')}), o AS (SELECT * FROM {sql_values(OWNERS, 'prefix', 'model')}), m AS (SELECT id, prefix, model, substr(id, length(prefix) + 1) AS rest, row_number() OVER (PARTITION BY id ORDER BY length(prefix) DESC) AS r FROM i JOIN o ON starts_with(id, prefix) WHERE regexp_full_match(substr(id, length(prefix) + 1), '[0-9]+')) SELECT id, prefix, model FROM m WHERE r = 1 AND rest::INT <= 99")
def f7_family_of(spark, sf):
    return H.family_of(values(spark, "id string", IDS), values(spark, "prefix string, model string", OWNERS))


# case, class proposed, property proposed
ANSWERS = [("q1", "K12", "R8"), ("q1", "K22", "R8"), ("q2", "K39", "R4"), ("q2", "K55", "R4i"), ("q3", "K21", "R4.1"), ("q3", "K21", "R99"), ("q4", "K21", "R4"), ("q4", "K7", "R4")]


@query(BASE + f""", a AS (SELECT * FROM {sql_values(ANSWERS, 'case_id', 'class_id', 'prop')}), h AS (SELECT DISTINCT case_id, ancestor FROM a JOIN clo ON clo.id = class_id),
    p AS (SELECT DISTINCT case_id, prop, CASE WHEN prop IN (SELECT id FROM qualifiers) THEN 'dotted' WHEN prop IN (SELECT id FROM properties) THEN 'plain' WHEN prop LIKE '%i' AND left(prop, length(prop) - 1) IN (SELECT id FROM properties) THEN 'inverse' ELSE 'unknown' END AS kind FROM a),
    n AS (SELECT case_id, prop, kind, CASE kind WHEN 'plain' THEN (SELECT domain FROM properties WHERE id = prop) WHEN 'inverse' THEN (SELECT range FROM properties WHERE id = left(prop, length(prop) - 1)) END AS needs FROM p)
    SELECT case_id, prop, kind, needs, needs IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.case_id = n.case_id AND ancestor = needs) AS orphan FROM n""")
def g27_domains(spark, sf):
    """Proposed properties whose domain (range, if inverse) no proposed class of the case satisfies."""
    return H.orphan_properties(model(spark), values(spark, "case_id string, class_id string, prop string", ANSWERS))
