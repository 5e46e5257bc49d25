"""A model's family: extensions and historical ids, the view of all models together, names and namespaces, checks of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .hierarchy import Model, family_of


def extensions(mentions: DataFrame, family: DataFrame, known: DataFrame, owners: DataFrame) -> DataFrame:
    """id, status, label, model, kind, mentions of every declared family id and every mentioned one whose prefix belongs to a model.

    mentions: id, n; family: id, label, model, kind; owners: prefix, model, kind. Known ids and mentioned ones of no model are left out.
    """
    every = mentions.select("id").unionByName(family.select("id")).distinct().join(known.select("id").distinct(), "id", "left_anti")
    declared = family.select("id", "label", "model", "kind", F.lit(True).alias("declared"))
    resolved = family_of(every, owners.select("prefix", F.to_json(F.struct("model", "kind")).alias("model"))).select("id", F.get_json_object("model", "$.model").alias("by_model"), F.get_json_object("model", "$.kind").alias("by_kind"))
    whole = every.join(declared, "id", "left").join(resolved, "id", "left").join(mentions.select("id", "n"), "id", "left").where("declared OR by_model IS NOT NULL")
    status = F.when(F.col("declared"), "current").otherwise("historical")
    return whole.select("id", status.alias("status"), "label", F.coalesce("model", "by_model").alias("model"), F.coalesce("kind", "by_kind").alias("kind"), F.coalesce("n", F.lit(0)).cast("long").alias("mentions"))


def historical(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """id, mentions of what the archive names and the model doesn't define."""
    return mentions.join(known.select("id").distinct(), "id", "left_anti").select("id", F.col("n").alias("mentions"))


def model_view(base: Model, added: DataFrame, edges: DataFrame) -> Model:
    """Base and extensions as one model: an extension with a domain is a property; the base wins where ids collide.

    added: id, label, model, domain, range; edges: child, parent of added concepts.
    """
    source = F.col("model").alias("source")
    is_property = F.coalesce("domain", F.lit("")) != ""
    classes = added.where(~is_property).join(base.classes.select("id"), "id", "left_anti")
    properties = added.where(is_property).join(base.properties.select("id"), "id", "left_anti")
    null = lambda: F.lit(None).cast("string")
    return Model(
        base.classes.unionByName(classes.select("id", "label", source)),
        base.class_edges.unionByName(edges.join(classes.select(F.col("id").alias("child")), "child", "left_semi").select("child", "parent")),
        base.properties.unionByName(properties.select("id", F.col("label").alias("direct"), null().alias("inverse"), "domain", "range", null().alias("quantification"), source)),
        base.property_edges.unionByName(edges.join(properties.select(F.col("id").alias("child")), "child", "left_semi").select("child", "parent")),
        base.qualifiers,
    )


def owned_namespaces(base: str, *addressed: DataFrame) -> DataFrame:
    """ns: the model's own namespace and every one that an entry's uri stands in."""
    out = addressed[0].sparkSession.range(1).select(F.lit(base).alias("ns"))
    for df in addressed:
        out = out.unionByName(df.where(F.coalesce("uri", F.lit("")) != "").select(X.namespace_of("uri").alias("ns")))
    return out.distinct()


def display_names(m: Model, added: DataFrame, former: DataFrame, documents: DataFrame) -> DataFrame:
    """id, name, bucket: what to call any id: class, property (and its inverse), qualifier, extension, historical id, document chunk; the first of these wins."""
    named = [
        m.classes.select("id", F.col("label").alias("name"), F.lit("class").alias("bucket")),
        m.properties.select("id", F.col("direct").alias("name"), F.lit("property").alias("bucket")),
        m.properties.where("inverse IS NOT NULL").select(F.concat("id", F.lit("i")).alias("id"), F.col("inverse").alias("name"), F.lit("property").alias("bucket")),
        m.qualifiers.select("id", F.col("label").alias("name"), F.lit("qualifier").alias("bucket")),
        added.select("id", F.col("label").alias("name"), F.lit("extension").alias("bucket")),
        former.select("id", F.lit(None).cast("string").alias("name"), F.lit("historical").alias("bucket")),
        documents.select(F.col("chunk_id").alias("id"), F.col("heading").alias("name"), F.lit("document").alias("bucket")),
    ]
    every = None
    for prio, df in enumerate(named):
        own = df.withColumn("prio", F.lit(prio))
        every = own if every is None else every.unionByName(own)
    best = every.groupBy("id").agg(F.min(F.struct("prio", "name", "bucket")).alias("b"))
    return best.select("id", F.coalesce("b.name", "id").alias("name"), "b.bucket")


def checked_ids(rows: DataFrame, key: str, ids: str, current: DataFrame, former: DataFrame, added: DataFrame) -> DataFrame:
    """key, current, historical, extension, bogus: ids of any spelling sorted into what they are; an extension counts only if the archive mentions it.

    current, former: id; added: id, mentions.
    """
    raw = rows.select(key, F.explode(F.array_distinct(F.col(ids))).alias("raw")).withColumn("id", X.leading_id("raw"))
    every = current.select("id", F.lit(0).alias("bucket")).unionByName(former.select("id", F.lit(1).alias("bucket"))).unionByName(added.where("mentions > 0").select("id", F.lit(2).alias("bucket")))
    found = raw.join(every.groupBy("id").agg(F.min("bucket").alias("bucket")), "id", "left")
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("bucket") == k, F.col("id"))))
    split = found.groupBy(key).agg(of(0).alias("current"), of(1).alias("historical"), of(2).alias("extension"), F.array_sort(F.collect_set(F.when(F.col("bucket").isNull(), F.col("raw")))).alias("bogus"))
    none = F.array().cast("array<string>")
    return rows.select(key).distinct().join(split, key, "left").select(key, *[F.coalesce(c, none).alias(c) for c in ("current", "historical", "extension", "bogus")])


def class_like(bucket: Column, domain: Column, kind: Column) -> Column:
    """Whether an entry stands for a class: by its bucket; an extension by its kind, else by having no domain."""
    return F.when(bucket == "class", True).when(bucket.isin("property", "qualifier"), False).when(kind.isNotNull(), kind == "class").otherwise(F.coalesce(domain, F.lit("")) == "")


def listing_of(listing: DataFrame, model: str) -> DataFrame:
    """The rows of one model, its name in any case; an unknown name is an error that tells the known ones."""
    found = listing.where(F.lower("source") == model.lower())
    if found.isEmpty():
        known = sorted(r["source"] for r in listing.select("source").distinct().limit(100).collect())
        raise ValueError(f"unknown model {model!r}; there are {', '.join(known)}")
    return found


def concept_answer(m: Model, asked: DataFrame, edges: DataFrame, narratives: DataFrame, mentions: DataFrame, most_siblings: int = 10, most_narratives: int = 3) -> DataFrame:
    """asked, label, parents, siblings, narratives, mentions of each asked class: a few siblings by name, and the narratives that name fewest concepts."""
    own = asked.select(F.col("asked").alias("id")).distinct().join(m.classes.select("id", "label"), "id")
    up = edges.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    near = edges.select(F.col("child").alias("id"), "parent").join(own.select("id"), "id", "left_semi").join(edges.select(F.col("child").alias("sibling"), "parent"), "parent").where("id <> sibling")
    beside = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("sibling")), 1, most_siblings).alias("siblings"))
    about = narratives.select("chunk_id", F.size("entities").alias("n"), F.explode(F.array_distinct("entities")).alias("id")).join(own.select("id"), "id", "left_semi")
    few = about.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("n", "chunk_id"))).where(F.col("k") <= most_narratives)
    told = few.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "chunk_id"))), lambda x: x["chunk_id"]).alias("narratives"))
    none = F.array().cast("array<string>")
    whole = own.join(up, "id", "left").join(beside, "id", "left").join(told, "id", "left").join(mentions.select("id", F.col("n").alias("mentions")), "id", "left")
    return whole.select(F.col("id").alias("asked"), "label", *[F.coalesce(c, none).alias(c) for c in ("parents", "siblings", "narratives")], F.coalesce("mentions", F.lit(0)).alias("mentions"))
