"""Sources of a model: its specification in XML, a family of extensions, RDFS encodings, and newer declarations as flat text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.mail import strip_tags, strip_tags_udf
from ..functions.rows import per_row
from ..operators.hierarchy import Model
from ..operators.validate import uri_index
from .graphs import RDF, RDFS

OWL = "http://www.w3.org/2002/07/owl#"
# Types that declare a class or property; headings of a flat declaration.
DECLARING = (f"{RDFS}Class", f"{OWL}Class", f"{RDF}Property", f"{OWL}ObjectProperty", f"{OWL}DatatypeProperty")
HEADERS = ("Subclass of:", "Subproperty of:", "Superclass of:", "Superproperty of:", "Domain:", "Range:", "Quantification:", "Scope note:", "Properties:", "Full path:", "Examples:", "Example:", "In first-order logic:")

_POINTER = "array<struct<_id: string, _VALUE: string>>"
_CLASS = f"_id string, fullName string, className string, subClassOf {_POINTER}, scopeNote string, examples string"
_QUALIFIER = f"array<struct<_id: string, labelText: string, range: {_POINTER}>>"
_PROPERTY = f"_id string, fullName string, directName string, inverseName string, domain {_POINTER}, range {_POINTER}, subPropertyOf {_POINTER}, scopeNote string, examples string, quantification string, propertyOfProperty {_QUALIFIER}"


#: List items of a marked-up text, without marks; empty ones go.
_examples = per_row(lambda x: [t for t in map(strip_tags, re.split(r"<li[^>]*>", x)) if t] if x else [], T.ArrayType(T.StringType()))


def _ids(pointers: str) -> Column:
    own = F.transform(F.coalesce(F.col(pointers), F.array().cast(_POINTER)), lambda p: p["_id"])
    return F.filter(own, lambda i: F.coalesce(i, F.lit("")) != "")


def _one(pointers: str) -> Column:
    return F.get(_ids(pointers), 0)


def read_specification(spark: SparkSession, path: str) -> tuple[Model, DataFrame, DataFrame]:
    """The model of a specification, and its classes and properties with notes, examples and parents.

    Where the document states how many classes and properties it has, other numbers are an error.
    """
    rows = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    c = rows("class", _CLASS).select(F.col("_id").alias("id"), F.coalesce("fullName", "_id").alias("full_name"), text("className").alias("label"), _ids("subClassOf").alias("sub_class_of"), strip_tags_udf("scopeNote").alias("scope_note"), _examples("examples").alias("examples"))
    raw = rows("property", _PROPERTY)
    p = raw.select(F.col("_id").alias("id"), F.coalesce("fullName", "_id").alias("full_name"), text("directName").alias("direct"), F.nullif(text("inverseName"), F.lit("")).alias("inverse"), _one("domain").alias("domain"), _one("range").alias("range"), _ids("subPropertyOf").alias("sub_property_of"), strip_tags_udf("scopeNote").alias("scope_note"), _examples("examples").alias("examples"), strip_tags_udf("quantification").alias("quantification"))
    nested = raw.select(F.col("_id").alias("of_property"), F.explode("propertyOfProperty").alias("q")).where("q._id IS NOT NULL")
    q = nested.select(F.col("q._id").alias("id"), "of_property", F.coalesce("q.labelText", F.lit("")).alias("label"), F.get(F.transform("q.range", lambda r: r["_id"]), 0).alias("range"))
    check_declared_counts(spark, path, {"classes": c.count(), "properties": p.count()})
    base = F.lit("base").alias("source")
    edges = lambda df, up: df.select(F.col("id").alias("child"), F.explode(up).alias("parent"))
    m = Model(c.select("id", "label", base), edges(c, "sub_class_of"), p.select("id", "direct", "inverse", "domain", "range", "quantification", base), edges(p, "sub_property_of"), q.select("id", "of_property", "label"))
    return m, c, p


def check_declared_counts(spark: SparkSession, path: str, counts: dict[str, int]) -> None:
    """Compares what was read with what the root element says of itself, if it does."""
    head = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"<[A-Za-z][^>]*>", 0).alias("root")).first()
    for name, n in counts.items():
        found = spark.range(1).select(F.regexp_extract(F.lit(head["root"] if head else ""), rf'\b{name}="(\d+)"', 1).alias("n")).first()["n"]
        if found and int(found) != n:
            raise ValueError(f"{path} declares {found} {name}, {n} were read")


FAMILY = "label string, model string, kind string, uri string, scope_note string, sub_class_of array<string>, super_class_of array<string>, domain string, range string, sub_property_of array<string>, super_property_of array<string>"


def read_object_map(spark: SparkSession, path: str, value: str, field: str | None = None, key: str = "id") -> DataFrame:
    """Rows of a JSON object that maps keys to objects (or of one of its fields): the key beside the value's fields."""
    kind = T.MapType(T.StringType(), T.StructType.fromDDL(value))
    schema = kind if field is None else T.StructType().add(field, kind)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("o"))
    return whole.select(F.explode(F.col("o") if field is None else F.col(f"o.{field}")).alias(key, "__v")).select(key, "__v.*")


def read_family(spark: SparkSession, path: str) -> DataFrame:
    """id beside the declared fields of every concept of the family's collection."""
    return read_object_map(spark, path, FAMILY, "entries")


def _subjects(triples: DataFrame, keys: list[str]) -> DataFrame:
    """Declared classes and properties: keys, subject, label (English, else without a language), domain, range, comment, parents (in order of name)."""
    of = lambda p: F.col("predicate") == RDFS + p
    language = F.lower(F.coalesce("language", F.lit("")))
    english, plain = F.min(F.when(of("label") & (language == "en"), F.col("object"))), F.min(F.when(of("label") & (language == ""), F.col("object")))
    declared = F.bool_or((F.col("predicate") == RDF + "type") & F.col("object").isin(*DECLARING))
    one = lambda p: F.min(F.when(of(p), F.col("object")))
    up = F.array_sort(F.collect_set(F.when(of("subClassOf") | of("subPropertyOf"), F.col("object"))))
    rows = triples.where("error IS NULL AND NOT startswith(subject, '_:')").groupBy(*keys, "subject")
    return rows.agg(declared.alias("declared"), F.coalesce(english, plain).alias("label"), one("domain").alias("domain_uri"), one("range").alias("range_uri"), one("comment").alias("scope_note"), up.alias("up")).where("declared").drop("declared")


def _suffix(label: Column) -> Column:
    return F.concat(F.lit("_"), F.regexp_replace(F.trim(label), r"\s+", "_"))


def _stem(local: Column, label: Column) -> Column:
    """The identifier before a local name's label; null if the name doesn't end in its label."""
    suffix = _suffix(label)
    return F.when(F.endswith(local, suffix) & (F.length(local) > F.length(suffix)), F.expr("left(local, length(local) - length(__suffix))"))


def rdfs_additions(triples: DataFrame, m: Model, namespace: str) -> tuple[DataFrame, DataFrame]:
    """Classes (id, label, sub_class_of) and properties (id, direct, domain, range, sub_property_of) that an RDFS encoding of the
    model's own namespace declares and the model lacks.

    A literal range is taken from the first parent that has one. A declaration whose id can't be told is an error, never left out.
    """
    index = uri_index(m).select("key", F.col("id").alias("known"))
    local = F.expr(f"substr(subject, {len(namespace) + 1})")
    found = _subjects(triples, []).where(F.startswith("subject", F.lit(namespace))).withColumn("local", local).withColumn("__suffix", _suffix(F.col("label")))
    new = found.join(index.withColumnRenamed("key", "__key"), F.lower("local") == F.col("__key"), "left_anti").withColumn("id", _stem(F.col("local"), F.col("label")))
    lost = [r["subject"] for r in new.where("id IS NULL").select("subject").orderBy("subject").limit(20).collect()]
    if lost:
        raise ValueError(f"declarations without an identifier: {', '.join(lost)}")
    known = lambda uri: F.lower(X.local_name(uri))
    parents = new.select("id", F.posexplode("up").alias("pos", "uri")).withColumn("key", known("uri")).join(index, "key").select("id", "pos", F.col("known").alias("parent"))
    up = parents.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parent"))), lambda x: x["parent"]).alias("parents"))
    inherited = parents.join(m.properties.select(F.col("id").alias("parent"), F.col("range").alias("r")).where("r IS NOT NULL"), "parent").groupBy("id").agg(F.min_by("r", "pos").alias("inherited"))
    side = lambda name: index.select(F.col("key").alias(f"{name}_key"), F.col("known").alias(name))
    whole = new.withColumn("domain_key", known("domain_uri")).withColumn("range_key", F.when(F.col("range_uri") != RDFS + "Literal", known("range_uri")))
    whole = whole.join(side("domain"), "domain_key", "left").join(side("range"), "range_key", "left").join(up, "id", "left").join(inherited, "id", "left")
    none = F.array().cast("array<string>")
    classes = whole.where("domain_uri IS NULL").select("id", "label", F.coalesce("parents", none).alias("sub_class_of"))
    properties = whole.where("domain_uri IS NOT NULL").select("id", F.col("label").alias("direct"), "domain", F.coalesce("range", "inherited").alias("range"), F.coalesce("parents", none).alias("sub_property_of"))
    return classes, properties


def model_of_file(path: Column) -> Column:
    """The model that a file such as `Name_v3.2.rdf` is named after."""
    return F.regexp_extract(path, r"([^/]+?)(?:_v[^/]*|\.[^/]*)?$", 1)


def family_declarations(triples: DataFrame) -> DataFrame:
    """model, namespace, uri, local, label, id, domain_uri, range_uri of family RDFS files: a model's namespace is the one that most
    of its declarations share (the first by name among equals), and others are left out."""
    rows = _subjects(triples.withColumn("model", model_of_file(F.col("doc_id"))), ["model"]).withColumn("namespace", X.namespace_of("subject"))
    counts = rows.groupBy("model", "namespace").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("model").agg(F.min(F.struct((-F.col("n")).alias("m"), "namespace")).alias("b")).select("model", F.col("b.namespace").alias("namespace"))
    own = rows.join(most, ["model", "namespace"]).withColumn("local", X.local_name("subject")).withColumn("__suffix", _suffix(F.col("label")))
    return own.select("model", "namespace", F.col("subject").alias("uri"), "local", "label", F.upper(_stem(F.col("local"), F.col("label"))).alias("id"), "domain_uri", "range_uri")


def family_rdfs(triples: DataFrame, m: Model, extensions: DataFrame) -> DataFrame:
    """extensions (id, label, model, kind, uri, domain, range) with the addresses that their own files give, and what only these files declare.

    The base model wins any collision; an inverse's address isn't a property's own.
    """
    declared = family_declarations(triples)
    index = uri_index(m).select("key", F.col("id").alias("known"), "inverse")
    base = m.classes.select("id").unionByName(m.properties.select("id"))
    other = extensions.select(F.lower(F.concat("id", _suffix(F.col("label")))).alias("key"), F.col("id").alias("named")).where("key IS NOT NULL")
    met = declared.withColumn("key", F.lower("local")).join(index, "key", "left").join(other, "key", "left").where("NOT coalesce(inverse, false)")
    met = met.withColumn("id", F.coalesce("known", "named", "id")).where("id IS NOT NULL").join(base, "id", "left_anti")
    first = Window.partitionBy("id").orderBy("uri")
    once = met.withColumn("n", F.row_number().over(first)).where("n = 1")
    filled = extensions.join(once.select("id", F.col("uri").alias("declared_uri")), "id", "left").withColumn("uri", F.coalesce(F.nullif("uri", F.lit("")), "declared_uri")).drop("declared_uri")
    ends = lambda c: F.lower(X.local_name(c))
    side = lambda name: index.select(F.col("key").alias(f"{name}_key"), F.col("known").alias(name))
    new = once.join(extensions.select("id"), "id", "left_anti").withColumn("domain_key", ends("domain_uri")).withColumn("range_key", ends("range_uri")).drop("key")
    new = new.join(side("domain"), "domain_key", "left").join(side("range"), "range_key", "left")
    kind = F.when(F.col("domain_uri").isNotNull(), "property").otherwise("class")
    return filled.select("id", "label", "model", "kind", "uri", "domain", "range").unionByName(new.select("id", "label", "model", kind.alias("kind"), "uri", "domain", "range"))


def declaration_section(text: Column | str, header: str) -> Column:
    """Lines under a heading of a flat declaration, up to the next heading; blank ones go."""
    lines = F.transform(F.split(X.col(text), "\n"), F.trim)
    after = F.slice(lines, F.array_position(lines, header) + 1, F.size(lines))
    stops = F.filter(F.transform(after, lambda x, i: F.when(x.isin(*HEADERS), i)), lambda i: i.isNotNull())
    own = F.slice(after, 1, F.coalesce(F.get(stops, 0), F.size(after)))
    return F.when(F.array_contains(lines, header), F.filter(own, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def specification_additions(declarations: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes and properties that newer declarations (id, heading, text) hold and the model lacks. A class's parent is the first
    class on the line; a property's is the first property, for its line states a whole path."""
    new = declarations.join(known.select("id").distinct(), "id", "left_anti")
    first = lambda header, kinds: F.nullif(F.regexp_extract(F.array_join(declaration_section("text", header), "\n"), rf"\b([{kinds}]\d{{1,3}})i?\b", 1), F.lit(""))
    name = F.trim(F.when(F.startswith(F.trim("heading"), F.col("id")), F.expr("substr(trim(heading), length(id) + 1)")).otherwise(""))
    named = new.withColumn("name", X.direct_and_inverse(name))
    parents = lambda header, kind: F.filter(F.array(first(header, kind)), lambda x: x.isNotNull())
    note = F.array_join(declaration_section("text", "Scope note:"), " ").alias("scope_note")
    classes = named.where(F.startswith("id", F.lit("E"))).select("id", F.coalesce(F.nullif("name.direct", F.lit("")), F.trim("heading")).alias("label"), parents("Subclass of:", "E").alias("sub_class_of"), note)
    properties = named.where(~F.startswith("id", F.lit("E"))).select("id", F.col("name.direct").alias("direct"), F.col("name.inverse").alias("inverse"), first("Domain:", "EP").alias("domain"), first("Range:", "EP").alias("range"), parents("Subproperty of:", "P").alias("sub_property_of"), F.array_join(declaration_section("text", "Quantification:"), " ").alias("quantification"), note)
    return classes, properties
