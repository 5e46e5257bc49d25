"""Hierarchies of classes and properties: closure, distance, depth, applicable and connecting properties, listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .worktables import materialise

MOST_DOUBLINGS = 40
REQUIRED = "necessary"  # fixed value: the word that makes a quantification binding


@dataclass
class Model:
    """classes (id, label, source), class_edges (child, parent), properties (id, direct, inverse, domain, range, quantification,
    source), property_edges (child, parent), qualifiers (id, of_property, label): properties of properties."""

    classes: DataFrame
    class_edges: DataFrame
    properties: DataFrame
    property_edges: DataFrame
    qualifiers: DataFrame


def _steps(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("id"), F.col("parent").alias("ancestor")).where("id IS NOT NULL AND ancestor IS NOT NULL AND id <> ancestor").distinct()


def reach(edges: DataFrame) -> DataFrame:
    """id, ancestor, distance (fewest hops, from 1) of all that lies above, by doubling.

    A pair that is between n and 2n hops apart goes through a node at exactly n hops, so each round joins only the pairs
    found last at that distance with all pairs known: the rounds grow with the logarithm of the longest distance, and every
    pair is kept once, in diamonds and cycles too.
    """
    known, hops = materialise(_steps(edges).select("id", "ancestor", F.lit(1).cast("long").alias("distance")), "reach"), 1
    for _ in range(MOST_DOUBLINGS):
        border = known.where(F.col("distance") == hops).select("id", F.col("ancestor").alias("middle"))
        if border.isEmpty():
            return known
        onward = known.select(F.col("id").alias("middle"), "ancestor", F.col("distance").alias("more"))
        found = border.join(onward, "middle").where("id <> ancestor").groupBy("id", "ancestor").agg((F.min("more") + hops).alias("distance"))
        known = materialise(known.unionByName(found.join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti")), "reach")
        hops *= 2
    raise RuntimeError(f"a hierarchy of more than 2^{MOST_DOUBLINGS} levels")


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, ancestor, distance (fewest hops) of every node, itself included; diamonds count once."""
    own = nodes.select("id").distinct()
    return own.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance")).unionByName(reach(edges).join(own, "id", "left_semi"))


def _longest(steps: DataFrame) -> DataFrame | None:
    """id, ancestor, hops of the longest walks, by doubling; None as soon as a walk comes back to where it began."""
    walked, before = materialise(steps.select("id", "ancestor", F.lit(1).cast("long").alias("hops")), "walks"), None
    for _ in range(MOST_DOUBLINGS):
        state = walked.agg(F.count(F.lit(1)), F.sum("hops"), F.count_if(F.col("id") == F.col("ancestor"))).first()
        if state[2]:
            return None
        if state == before:
            return walked
        before = state
        onward = walked.select(F.col("id").alias("middle"), "ancestor", F.col("hops").alias("more"))
        longer = walked.withColumnRenamed("ancestor", "middle").join(onward, "middle").select("id", "ancestor", (F.col("hops") + F.col("more")).alias("hops"))
        walked = materialise(walked.unionByName(longer).groupBy("id", "ancestor").agg(F.max("hops").alias("hops")), "walks")
    raise RuntimeError(f"a hierarchy of more than 2^{MOST_DOUBLINGS} levels")


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth: the longest walk up; a walk never enters a node twice.

    Longest walks are doubled like shortest ones. That needs a hierarchy without cycles; where there is one, what can reach it is
    walked path by path instead, and only the rest is doubled.
    """
    own, steps, caught = nodes.select("id").distinct(), _steps(edges), None
    if (walked := _longest(steps)) is None:
        above = reach(edges)
        back = above.select(F.col("ancestor").alias("id"), F.col("id").alias("ancestor"))
        cyclic = above.join(back, ["id", "ancestor"], "left_semi").select("id").distinct()
        caught = materialise(cyclic.unionByName(above.join(cyclic.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select("id")).distinct(), "cycles")
        walked = _longest(steps.join(caught, "id", "left_anti"))
    deep = walked.groupBy("id").agg(F.max("hops").alias("depth"))
    if caught is not None:
        deep = deep.unionByName(_simple_walks(caught, edges))
    return own.join(deep, "id", "left").select("id", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def _simple_walks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth by every walk that enters no node twice; too many walks are an error of Spark's recursion limits."""
    text = """
        WITH RECURSIVE up(id, ancestor, hops, path) AS (
            SELECT id, id, 0L, array(id) FROM {nodes}
            UNION ALL
            SELECT up.id, e.ancestor, up.hops + 1, array_append(up.path, e.ancestor) FROM up JOIN {steps} e ON e.id = up.ancestor WHERE NOT array_contains(up.path, e.ancestor))
        SELECT id, max(hops) AS depth FROM up GROUP BY id"""
    return nodes.sparkSession.sql(text, nodes=nodes, steps=_steps(edges))


def resolved(ids: DataFrame, known: DataFrame, column: str = "id") -> DataFrame:
    """Adds base and inverse: an id itself, or without its final `i` if only that is known."""
    plain, stripped = known.select(F.col("id").alias("__p")), known.select(F.col("id").alias("__s"))
    trimmed = F.when(F.col(column).endswith("i"), F.expr(f"left({column}, length({column}) - 1)"))
    out = ids.join(plain, F.col(column) == F.col("__p"), "left").join(stripped, (trimmed == F.col("__s")) & F.col("__p").isNull(), "left")
    return out.withColumn("base", F.coalesce("__p", "__s")).withColumn("inverse", F.col("__p").isNull() & F.col("__s").isNotNull()).drop("__p", "__s")


def property_depths(m: Model) -> DataFrame:
    """Depth in the property hierarchy; parents named by their inverse count as the property itself."""
    up = resolved(m.property_edges, m.properties, "parent").where("base IS NOT NULL").select("child", F.col("base").alias("parent"))
    return depths(m.properties, up)


def is_required(quantification: Column) -> Column:
    return F.coalesce(F.contains(quantification, F.lit(REQUIRED)), F.lit(False))


def property_closure(m: Model) -> DataFrame:
    """class_id, direction, property_id, place: what a class can carry or be the target of, most specific first."""
    up = closure(m.classes, m.class_edges)
    deep = m.properties.join(property_depths(m), "id").select(F.col("id").alias("property_id"), "depth", "domain", "range")
    one = lambda side, name: up.join(deep, F.col("ancestor") == F.col(side)).select(F.col("id").alias("class_id"), F.lit(name).alias("direction"), "property_id", "depth")
    w = Window.partitionBy("class_id", "direction").orderBy(F.desc("depth"), "property_id")
    return one("domain", "outgoing").unionByName(one("range", "incoming")).withColumn("place", F.row_number().over(w)).drop("depth")


def applicable(m: Model) -> DataFrame:
    """class_id, property_id, direction, via, distance, required, place: nearest declarations first."""
    up = closure(m.classes, m.class_edges)
    p = m.properties.join(property_depths(m), "id").select(F.col("id").alias("property_id"), "depth", "domain", "range", is_required(F.col("quantification")).alias("needed"))
    out = up.join(p, F.col("ancestor") == F.col("domain")).select(F.col("id").alias("class_id"), "property_id", F.lit("outgoing").alias("direction"), F.col("ancestor").alias("via"), "distance", F.col("needed").alias("required"), "depth")
    into = up.join(p, F.col("ancestor") == F.col("range")).select(F.col("id").alias("class_id"), "property_id", F.lit("incoming").alias("direction"), F.col("ancestor").alias("via"), "distance", F.lit(False).alias("required"), "depth")
    w = Window.partitionBy("class_id", "direction").orderBy("distance", F.desc("depth"), "property_id")
    return out.unionByName(into).withColumn("place", F.row_number().over(w)).drop("depth")


def connecting(m: Model, pairs: DataFrame) -> DataFrame:
    """subject, object, property_id, generality, exact, place for pairs (subject, object): declared on the pair itself first."""
    up = closure(m.classes, m.class_edges)
    left, right = (up.select(F.col("id").alias(name), F.col("ancestor").alias(side), F.col("distance").alias(f"{name}_hops")) for name, side in (("subject", "domain"), ("object", "range")))
    p = m.properties.join(property_depths(m), "id").select(F.col("id").alias("property_id"), "depth", "domain", "range")
    found = pairs.join(left, "subject").join(p, "domain").join(right, ["object", "range"])
    general = F.col("subject_hops") + F.col("object_hops")
    w = Window.partitionBy("subject", "object").orderBy("generality", F.desc("depth"), "property_id")
    return found.select("subject", "object", "property_id", general.alias("generality"), (general == 0).alias("exact"), "depth").withColumn("place", F.row_number().over(w)).drop("depth")


def skeleton(m: Model) -> DataFrame:
    """id, parents, children, each sorted."""
    gather = lambda key, value, name: m.class_edges.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(value)).alias(name))
    none = F.array().cast("array<string>")
    out = m.classes.select("id", "label").join(gather("child", "parent", "parents"), "id", "left").join(gather("parent", "child", "children"), "id", "left")
    return out.select("id", "label", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def siblings(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """id, sibling, parent for the ids that are asked: other children of a common parent."""
    own = edges.select("child", "parent").distinct()
    a, b = own.withColumnRenamed("child", "id").join(asked.select("id").distinct(), "id", "left_semi"), own.withColumnRenamed("child", "sibling")
    return a.join(b, "parent").where("id <> sibling").select("id", "sibling", "parent")


def sibling_groups(edges: DataFrame) -> DataFrame:
    """id, parent, siblings (how many) for every child: membership in its parent's group, never all pairs of a large one."""
    own = edges.select("child", "parent").distinct()
    sizes = own.groupBy("parent").agg((F.count(F.lit(1)) - 1).alias("siblings"))
    return own.withColumnRenamed("child", "id").join(sizes, "parent").select("id", "parent", "siblings")


def listing(m: Model, historical: DataFrame) -> DataFrame:
    """source, id, kind, label, place of everything: base model, extensions by name, historical ids; classes before properties, by number."""
    every = m.classes.select("source", "id", F.lit("class").alias("kind"), "label")
    every = every.unionByName(m.properties.select("source", "id", F.lit("property").alias("kind"), F.col("direct").alias("label")))
    every = every.unionByName(m.qualifiers.select(F.lit("base").alias("source"), "id", F.lit("qualifier").alias("kind"), "label"))
    every = every.unionByName(historical.select(F.lit("historical").alias("source"), "id", F.lit("historical").alias("kind"), F.lit(None).cast("string").alias("label")))
    source = F.when(F.col("source") == "base", 0).when(F.col("source") == "historical", 2).otherwise(1)
    number = lambda k: F.coalesce(F.regexp_extract("id", r"^([A-Z]+)(\d+)(?:\.(\d+))?", k).try_cast("int"), F.lit(0))
    key = [source, F.col("source"), F.when(F.col("kind") == "class", 0).otherwise(1), F.regexp_extract("id", "^([A-Z]+)", 1), number(2), number(3), F.col("id")]
    return every.withColumn("place", F.row_number().over(Window.orderBy(*key)))


def family_owner(members: DataFrame, overrides: DataFrame) -> DataFrame:
    """prefix, model: the model that most members of a prefix belong to, unless an override names one."""
    counts = members.groupBy("prefix", "model").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("prefix").agg(F.min(F.struct((-F.col("n")).alias("m"), "model")).alias("b")).select("prefix", F.col("b.model").alias("model"))
    fixed = overrides.select("prefix", F.col("model").alias("given"))
    return best.join(fixed, "prefix", "full_outer").select("prefix", F.coalesce("given", "model").alias("model"))


def family_of(ids: DataFrame, owners: DataFrame, most: int = 99) -> DataFrame:
    """id, prefix, model: the longest prefix whose rest is a number decides; numbers over `most` belong to none."""
    rest = F.expr("substr(id, length(prefix) + 1)")
    parts = ids.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("id"), F.lit(1))), lambda n: F.left("id", n))).alias("prefix"))
    met = parts.join(owners, "prefix").where(rest.rlike(r"^\d+$"))
    longest = met.groupBy("id").agg(F.max_by(F.struct("prefix", "model", rest.alias("rest")), F.length("prefix")).alias("b"))
    return longest.where(F.col("b.rest").try_cast("int") <= most).select("id", "b.prefix", "b.model")


def find_concepts(m: Model, asked: DataFrame) -> DataFrame:
    """asked, id, matches: a concept by id in any case, else by label in either direction; id is the first of classes, properties and
    qualifiers, matches are all that answer to the same."""
    named = [(0, m.classes, "label"), (1, m.properties, "direct"), (2, m.qualifiers, "label"), (1, m.properties.where("inverse IS NOT NULL"), "inverse")]
    every = None
    for prio, df, label in named:
        own = df.select(F.lit(prio).alias("prio"), "id", F.col(label).alias("label"))
        every = own if every is None else every.unionByName(own)
    own = asked.select("asked").distinct()
    by_id = own.join(every, F.upper("asked") == F.upper("id")).select("asked", F.lit(0).alias("how"), "prio", "id")
    by_label = own.join(every, F.lower("asked") == F.lower("label")).select("asked", F.lit(1).alias("how"), "prio", "id")
    met = by_id.unionByName(by_label).distinct().withColumn("best", F.min("how").over(Window.partitionBy("asked"))).where("how = best")
    return met.groupBy("asked").agg(F.min(F.struct("prio", "id")).alias("b"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("matches")).select("asked", "b.id", "matches")


def orphan_properties(m: Model, proposed: DataFrame) -> DataFrame:
    """case_id, prop, kind, needs, orphan for proposals (case_id, class_id, prop): whether no proposed class of the case is, or lies
    below, the property's domain (the range, if it is named by its inverse). Dotted and unknown ids need nothing."""
    up = closure(m.classes, m.class_edges).select(F.col("id").alias("class_id"), F.col("ancestor").alias("needs"))
    have = proposed.join(up, "class_id").select("case_id", "needs").distinct().withColumn("met", F.lit(True))
    dotted = m.qualifiers.select(F.col("id").alias("prop"), F.lit(True).alias("dotted"))
    asked = resolved(proposed.select("case_id", "prop").distinct(), m.properties, "prop").join(dotted, "prop", "left")
    kind = F.when(F.col("dotted"), "dotted").when(F.col("base").isNull(), "unknown").when(F.col("inverse"), "inverse").otherwise("plain")
    sides = m.properties.select(F.col("id").alias("base"), "domain", "range")
    side = F.when(F.col("kind") == "plain", F.col("domain")).when(F.col("kind") == "inverse", F.col("range"))
    needed = asked.withColumn("kind", kind).join(sides, "base", "left").withColumn("needs", side)
    return needed.join(have, ["case_id", "needs"], "left").select("case_id", "prop", "kind", "needs", (F.col("needs").isNotNull() & F.col("met").isNull()).alias("orphan"))
