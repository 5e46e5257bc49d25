"""Validation of links, documents, types and inverse claims against a model: one verdict per row, whole corpora at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .hierarchy import Model, closure, is_required

# Verdicts in the order in which they are tested, and those that fail a document.
VERDICTS = ("not_in_model", "unknown_name", "unchecked", "attached_to_property", "ambiguous", "ok", "ok_literal", "not_a_class_link", "unknown_class", "illegal")
FAILING = ("illegal", "unknown_name", "unknown_class", "not_a_class_link")


#: The order in which each kind of result is told.
ORDERS = {"links": ("path", "name"), "claims": ("subject", "object"), "findings": ("path", "raw"), "completeness": ("class_id", "property_id")}


def ordered(df: DataFrame, kind: str) -> DataFrame:
    return df.orderBy(*ORDERS[kind])


def candidates(m: Model, names: DataFrame) -> DataFrame:
    """name, property_id, inverse, qualifier: readings of names; only the first kind of reading that fits counts.

    Kinds in order: dotted qualifier, id in any case, id with `i` (only where an inverse name exists), local name of a
    URI as either, `id name` pairs, labels in both directions (shared labels keep every reading).
    """
    p, q = m.properties, m.qualifiers
    name = names.select("name").distinct().withColumn("u", F.upper(F.trim("name"))).withColumn("local", F.upper(F.regexp_extract(X.local_name("name"), r"^([A-Za-z]+\d+(?:\.\d+)?i?)(?:_|$)", 1)))
    name = name.withColumn("head", F.upper(F.regexp_extract("name", r"^\s*([A-Za-z]+\d+i?)[ _]\S", 1))).withColumn("key", X.label_key("name"))
    ids = p.select(F.col("id").alias("property_id"), F.upper("id").alias("up"), F.lit(False).alias("inverse"), F.lit(False).alias("qualifier"))
    inverses = p.where("inverse IS NOT NULL").select(F.col("id").alias("property_id"), F.upper(F.concat("id", F.lit("i"))).alias("up"), F.lit(True).alias("inverse"), F.lit(False).alias("qualifier"))
    dotted = q.select(F.col("id").alias("property_id"), F.upper("id").alias("up"), F.lit(False).alias("inverse"), F.lit(True).alias("qualifier"))
    labels = p.select(F.col("id").alias("property_id"), X.label_key("direct").alias("up"), F.lit(False).alias("inverse"), F.lit(False).alias("qualifier"))
    labels = labels.unionByName(p.where("inverse IS NOT NULL").select(F.col("id").alias("property_id"), X.label_key("inverse").alias("up"), F.lit(True).alias("inverse"), F.lit(False).alias("qualifier")))
    labels = labels.unionByName(q.select(F.col("id").alias("property_id"), X.label_key("label").alias("up"), F.lit(False).alias("inverse"), F.lit(True).alias("qualifier")))
    either = ids.unionByName(inverses)
    kinds = [("u", dotted), ("u", ids), ("u", inverses), ("local", dotted.unionByName(either)), ("head", either), ("key", labels)]
    every = None
    for n, (column, source) in enumerate(kinds):
        met = name.join(source, (F.col(column) == F.col("up")) & (F.col(column) != "")).select("name", "property_id", "inverse", "qualifier", F.lit(n).alias("kind"))
        every = met if every is None else every.unionByName(met)
    best = F.min("kind").over(Window.partitionBy("name"))
    return every.withColumn("best", best).where("kind = best").select("name", "property_id", "inverse", "qualifier").distinct()


def readings(m: Model, links: DataFrame) -> DataFrame:
    """link, spos, opos, subject, object, name, property_id, reading, legal (null for a qualifier), known: every reading of every pair of types.

    links: link, subject, name, object and optionally arrays subject_types and object_types, tried in order.
    """
    types = lambda many, one: F.when(F.size(F.coalesce(F.col(many), F.array().cast("array<string>"))) > 0, F.col(many)).otherwise(F.array(F.col(one)))
    pairs = links.select("link", "name", F.posexplode(types("subject_types", "subject")).alias("spos", "s"), "object_types", "object")
    pairs = pairs.select("link", "name", "spos", F.upper(F.trim("s")).alias("s"), F.posexplode(types("object_types", "object")).alias("opos", "o")).withColumn("o", F.upper(F.trim("o")))
    known = m.classes.select("id")
    pairs = pairs.join(known.select(F.col("id").alias("s"), F.lit(True).alias("s_known")), "s", "left").join(known.select(F.col("id").alias("o"), F.lit(True).alias("o_known")), "o", "left")
    pairs = pairs.withColumn("known", F.coalesce("s_known", F.lit(False)) & (F.col("o").isNull() | F.coalesce("o_known", F.lit(False)))).drop("s_known", "o_known")
    read = pairs.join(candidates(m, links), "name", "left")
    p = m.properties.select(F.col("id").alias("property_id"), "domain", "range", is_required(F.col("quantification")).alias("required"))
    read = read.join(p, "property_id", "left")
    read = read.withColumn("needs_s", F.when(F.col("inverse"), F.col("range")).otherwise(F.col("domain"))).withColumn("needs_o", F.when(F.col("inverse"), F.col("domain")).otherwise(F.col("range")))
    up = closure(m.classes, m.class_edges).select("id", "ancestor")
    for side in ("s", "o"):
        own = up.select(F.col("id").alias(side), F.col("ancestor").alias(f"needs_{side}"), F.lit(True).alias(f"{side}_fits"))
        read = read.join(own, [side, f"needs_{side}"], "left")
    s_ok = F.col("needs_s").isNull() | F.coalesce("s_fits", F.lit(False))
    o_ok = F.col("o").isNull() | F.col("needs_o").isNull() | F.coalesce("o_fits", F.lit(False))
    legal = F.when(~F.col("known") | F.col("property_id").isNull(), F.lit(False)).when(F.col("qualifier"), F.lit(None).cast("boolean")).otherwise(s_ok & o_ok)
    reading = F.concat("property_id", F.when(F.col("inverse"), F.lit("i")).otherwise(F.lit("")))
    return read.select("link", "spos", "opos", F.col("s").alias("subject"), F.col("o").alias("object"), "name", "property_id", reading.alias("reading"), legal.alias("legal"), "known", F.coalesce("qualifier", F.lit(False)).alias("qualifier"))


def link_verdicts(m: Model, links: DataFrame) -> DataFrame:
    """link, legal, resolved (the one legal reading), ambiguous (several): for single links."""
    found = readings(m, links).groupBy("link").agg(F.array_sort(F.collect_set(F.when(F.col("legal"), F.col("reading")))).alias("fits"))
    return found.select("link", (F.size("fits") > 0).alias("legal"), F.when(F.size("fits") == 1, F.element_at("fits", 1)).alias("resolved"), F.when(F.size("fits") > 1, F.col("fits")).alias("ambiguous"))


def document_verdicts(m: Model, links: DataFrame, owned: DataFrame) -> DataFrame:
    """link, verdict, resolved. links as in readings() and predicate_uri, via_property; owned: ns.

    The first legal pair of types speaks for a link, else its first pair does.
    """
    read = readings(m, links)
    pair = read.groupBy("link", "spos", "opos").agg(
        F.coalesce(F.bool_or("legal"), F.lit(False)).alias("legal"), F.array_sort(F.collect_set(F.when(F.col("legal"), F.col("reading")))).alias("fits"),
        F.bool_or(F.col("qualifier") & F.col("known")).alias("qualified"), F.count("property_id").alias("n"), F.first("known").alias("known"))
    spoken = pair.groupBy("link").agg(F.min(F.struct((~F.col("legal")).alias("il"), "spos", "opos", "legal", "fits", "qualified", "n", "known")).alias("b")).select("link", "b.*")
    ns = owned.select(F.col("ns"), F.lit(True).alias("is_owned"))
    whole = links.join(spoken, "link", "left").withColumn("ns", X.namespace_of("predicate_uri")).join(ns, "ns", "left")
    verdict = (
        F.when(F.col("predicate_uri").isNotNull() & (F.col("n") == 0), F.when(F.coalesce("is_owned", F.lit(False)), "unknown_name").otherwise("not_in_model"))
        .when(F.col("subject").isNull() & (F.size(F.coalesce("subject_types", F.array())) == 0), "unchecked")
        .when(F.col("via_property").isNotNull(), "attached_to_property")
        .when(F.col("legal") & (F.size("fits") > 1), "ambiguous")
        .when(F.col("legal"), F.when(F.col("object").isNotNull(), "ok").otherwise("ok_literal"))
        .when(F.col("known") & F.col("qualified"), "not_a_class_link")
        .when(~F.col("known"), "unknown_class")
        .when(F.col("n") == 0, "unknown_name")
        .otherwise("illegal")
    )
    return whole.select("link", verdict.alias("verdict"), F.when(F.col("legal") & (F.size("fits") == 1), F.element_at("fits", 1)).alias("resolved"))


def label_findings(m: Model, uses: DataFrame) -> DataFrame:
    """raw, path, verdict for uses (raw, path, id, label): malformed, unknown_class or label_mismatch; one per (raw, path)."""
    named = m.classes.select(F.col("id").alias("id"), F.col("label").alias("current")).unionByName(m.properties.select("id", F.col("direct").alias("current")))
    once = uses.dropDuplicates(["raw", "path"]).join(named.withColumn("there", F.lit(True)), "id", "left")
    verdict = F.when(F.coalesce("id", F.lit("")) == "", "malformed").when(F.col("there").isNull(), "unknown_class").when((F.coalesce("label", F.lit("")) != "") & (F.coalesce("current", F.lit("")) != "") & (F.lower("label") != F.lower(F.trim("current"))), "label_mismatch")
    return once.select("raw", "path", verdict.alias("verdict")).where("verdict IS NOT NULL")


def completeness(m: Model, links: DataFrame) -> DataFrame:
    """class_id, property_id, missing, instances where a required property is missing somewhere. links: path, subject, subject_types, name."""
    own = links.where("subject IS NOT NULL")
    types = F.when(F.size(F.coalesce("subject_types", F.array())) > 0, F.col("subject_types")).otherwise(F.array("subject"))
    nodes = own.select("path", F.explode(types).alias("class_id")).distinct()
    stated = own.join(candidates(m, own), "name").select("path", "property_id").distinct().withColumn("stated", F.lit(True))
    up = closure(m.classes, m.class_edges).select(F.col("id").alias("class_id"), "ancestor")
    needed = m.properties.where(is_required(F.col("quantification"))).select(F.col("id").alias("property_id"), F.col("domain").alias("ancestor"))
    asked = nodes.join(up.join(needed, "ancestor").select("class_id", "property_id").distinct(), "class_id")
    counted = asked.join(stated, ["path", "property_id"], "left").groupBy("class_id", "property_id").agg(F.count_if(F.col("stated").isNull()).alias("missing"), F.count(F.lit(1)).alias("instances"))
    return counted.where("missing > 0")


# What makes a document of either form fail.
RDF_FAILING = FAILING
XML_FAILING = ("unknown_name", "illegal", "unknown_class", "attached_to_property")
BAD_TYPES, BAD_CLAIMS, BAD_LABELS = ("unknown_class", "not_a_class"), ("not_invertible", "contradicted"), ("malformed", "unknown_class")


def _counted(found: DataFrame, value: str, name: str) -> DataFrame:
    """doc_id and a map of how often each value was found."""
    counts = found.groupBy("doc_id", value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias(name))


def _verdict(files: DataFrame, parts: list[tuple[DataFrame, str, tuple[str, ...]]]) -> DataFrame:
    """doc_id, error, the counts of each part, and failed: a document that can't be read fails, as does one with a bad value in any part."""
    out, bad = files, F.col("error").isNotNull()
    for counts, name, failing in parts:
        out = out.join(counts, "doc_id", "left")
        for value in failing:
            bad = bad | (F.coalesce(F.try_element_at(name, F.lit(value)), F.lit(0)) > 0)
    return out.withColumn("failed", bad)


def validate_rdf(triples: DataFrame, m: Model, owned: DataFrame, type_uri: str, inverse_uri: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, error, verdicts of links, findings of types, verdicts of inverse claims, failed.

    triples as read_rdf gives them; a document's own inverse claims (inverse_uri) also tell how its predicates are read.
    """
    own = triples.where("error IS NULL")
    claims = own.where(F.col("predicate") == inverse_uri)
    links = rdf_links(own, claims.select("subject", "object"), m, type_uri, (inverse_uri, *skip))
    verdicts = document_verdicts(m, links, owned).join(links.select("link", "doc_id"), "link")
    types = type_findings(m, own.where(F.col("predicate") == type_uri).select(F.concat_ws("|", "doc_id", "subject").alias("path"), F.col("object").alias("uri")), owned).select(F.split("path", r"\|")[0].alias("doc_id"), F.col("verdict").alias("finding"))
    judged = claims.select("doc_id", "subject", "object").join(inverse_claims(m, claims.select("subject", "object").distinct()), ["subject", "object"]).select("doc_id", F.col("verdict").alias("claim"))
    files = triples.groupBy("doc_id").agg(F.max("error").alias("error"))
    return _verdict(files, [(_counted(verdicts, "verdict", "verdicts"), "verdicts", RDF_FAILING), (_counted(types, "finding", "types"), "types", BAD_TYPES), (_counted(judged, "claim", "claims"), "claims", BAD_CLAIMS)])


def validate_xml(links: DataFrame, uses: DataFrame, m: Model, owned: DataFrame) -> DataFrame:
    """One row a document: doc_id, error, verdicts of links, findings of class labels, failed. links and uses as read_xml_links and read_class_uses give them."""
    null = lambda kind: F.lit(None).cast(kind)
    own = links.where("error IS NULL").select("doc_id", F.concat_ws("|", "doc_id", "link").alias("link"), "subject", null("array<string>").alias("subject_types"), "name", "object", null("array<string>").alias("object_types"), null("string").alias("predicate_uri"), "via_property", "path")
    verdicts = document_verdicts(m, own, owned).join(own.select("link", "doc_id"), "link")
    labels = label_findings(m, uses.where("error IS NULL").select("raw", F.concat_ws("|", "doc_id", "path").alias("path"), "id", "label")).select(F.split("path", r"\|")[0].alias("doc_id"), F.col("verdict").alias("finding"))
    files = links.select("doc_id", "error").unionByName(uses.select("doc_id", "error")).groupBy("doc_id").agg(F.max("error").alias("error"))
    return _verdict(files, [(_counted(verdicts, "verdict", "verdicts"), "verdicts", XML_FAILING), (_counted(labels, "finding", "labels"), "labels", BAD_LABELS)])


def uri_index(m: Model) -> DataFrame:
    """key (lower-cased local name or id), id, inverse, kind; the first writer of a key wins (classes, properties, inverses)."""
    rows = m.classes.select("id", F.lit(False).alias("inverse"), F.lit("class").alias("kind"), F.lower("id").alias("key"), F.lit(0).alias("prio"))
    rows = rows.unionByName(m.classes.select("id", F.lit(False).alias("inverse"), F.lit("class").alias("kind"), F.lower(F.concat_ws("_", "id", F.regexp_replace("label", r"\s+", "_"))).alias("key"), F.lit(0).alias("prio")))
    for inverse, label, prio in ((False, "direct", 1), (True, "inverse", 2)):
        own = m.properties.where(F.col(label).isNotNull())
        ident = F.concat("id", F.lit("i" if inverse else ""))
        for key in (ident, F.concat_ws("_", ident, F.regexp_replace(label, r"\s+", "_"))):
            rows = rows.unionByName(own.select("id", F.lit(inverse).alias("inverse"), F.lit("property").alias("kind"), F.lower(key).alias("key"), F.lit(prio).alias("prio")))
    w = Window.partitionBy("key").orderBy("prio", "id")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("key", "id", "inverse", "kind")


def resolve_uris(m: Model, uris: DataFrame, column: str = "uri") -> DataFrame:
    """Adds id, inverse and kind for full, prefixed and bare forms."""
    local = F.lower(F.regexp_extract(F.col(column), r"([^/#:]+)/?$", 1))
    return uris.withColumn("__k", local).join(uri_index(m).withColumnRenamed("key", "__k"), "__k", "left").drop("__k")


def type_findings(m: Model, uses: DataFrame, owned: DataFrame) -> DataFrame:
    """path, raw, verdict of types that are no classes of the model. uses: path, uri."""
    found = resolve_uris(m, uses).withColumn("ns", X.namespace_of("uri")).join(owned.withColumn("is_owned", F.lit(True)), "ns", "left")
    verdict = F.when(F.col("kind") == "class", None).when(F.col("kind") == "property", "not_a_class").when(F.col("is_owned"), "unknown_class").otherwise("not_in_model")
    return found.select("path", F.col("uri").alias("raw"), verdict.alias("verdict")).where("verdict IS NOT NULL")


def inverse_claims(m: Model, claims: DataFrame) -> DataFrame:
    """subject, object, verdict: foreign, not_invertible, bridge, contradicted or ok, tested in that order."""
    side = lambda c, p: resolve_uris(m, claims.select(c).distinct(), c).select(c, *[F.col(x).alias(f"{p}_{x}") for x in ("id", "inverse", "kind")])
    both = claims.join(side("subject", "l"), "subject", "left").join(side("object", "r"), "object", "left")
    is_class: Column = (F.coalesce("l_kind", F.lit("")) == "class") | (F.coalesce("r_kind", F.lit("")) == "class")
    verdict = (
        F.when(F.col("l_id").isNull() & F.col("r_id").isNull(), "foreign")
        .when(is_class, "not_invertible")
        .when(F.col("l_id").isNull() | F.col("r_id").isNull(), "bridge")
        .when((F.col("l_id") != F.col("r_id")) | (F.col("l_inverse") == F.col("r_inverse")), "contradicted")
        .otherwise("ok")
    )
    return both.select("subject", "object", verdict.alias("verdict"))


def rdf_links(triples: DataFrame, claims: DataFrame, m: Model, type_uri: str, skip: tuple[str, ...]) -> DataFrame:
    """Links of whole RDF documents: doc_id, link, subject_types, name, object_types, subject, object, path, predicate_uri, via_property.

    Predicates that a document declares as the inverse of a property are read as that property from the other end.
    triples: doc_id, subject, predicate, object, object_is_literal.
    """
    types = resolve_uris(m, triples.where(F.col("predicate") == type_uri).select("doc_id", "subject", F.col("object").alias("uri"))).where("kind = 'class'")
    typed = types.groupBy("doc_id", "subject").agg(F.array_sort(F.collect_set("id")).alias("types"))
    bridge = inverse_claims(m, claims.select("subject", "object")).where("verdict = 'bridge'")
    left = resolve_uris(m, bridge.select(F.col("subject").alias("uri"), F.col("object").alias("other"))).select("uri", "other", "id")
    alias = left.where("id IS NULL").select(F.col("uri").alias("predicate"), F.col("other").alias("stands_for")).unionByName(left.where("id IS NOT NULL").select(F.col("other").alias("predicate"), F.col("uri").alias("stands_for")))
    rows = triples.where(~F.col("predicate").isin(type_uri, *skip)).join(alias.distinct(), "predicate", "left")
    turned = F.col("stands_for").isNotNull() & ~F.col("object_is_literal")
    rows = rows.withColumn("from", F.when(turned, F.col("object")).otherwise(F.col("subject"))).withColumn("to", F.when(turned, F.col("subject")).otherwise(F.when(~F.col("object_is_literal"), F.col("object"))))
    rows = rows.withColumn("predicate_uri", F.coalesce("stands_for", "predicate"))
    s = typed.select("doc_id", F.col("subject").alias("from"), F.col("types").alias("subject_types"))
    o = typed.select("doc_id", F.col("subject").alias("to"), F.col("types").alias("object_types"))
    out = rows.join(s, ["doc_id", "from"], "left").join(o, ["doc_id", "to"], "left")
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    link = F.concat_ws("|", "doc_id", "from", "predicate_uri", F.coalesce("to", F.lit("")), "object")
    return out.select("doc_id", link.alias("link"), first("subject_types").alias("subject"), "subject_types", F.col("predicate_uri").alias("name"), "predicate_uri", first("object_types").alias("object"), "object_types", F.col("from").alias("path"), F.lit(None).cast("string").alias("via_property"))
