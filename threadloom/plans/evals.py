"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evals as E
from ..operators import hierarchy as H
from .common import query, sql_values, table, values
from .ontology import EDGES, model
from .search import SQL_TOKENS


@query("""SELECT lang AS difficulty, count(*) AS questions, count(quality) AS answered, count_if(quality = 1) AS found, count_if(toxic = 0 AND d.doc_id % 3 > 0) AS correct, count_if(toxic = 0 AND d.doc_id % 3 = 0) AS partial, count_if(toxic = 1) AS wrong, count_if(quality = 1 AND toxic = 1) AS bluffs
    FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def a17_eval_report(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "question_id")
    questions = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("difficulty"))
    verdict = F.when(F.col("toxic") == 1, "wrong").when(F.col("question_id") % 3 == 0, "partial").otherwise("correct")
    return E.report(questions, labels.select("question_id", (F.col("quality") == 1).alias("found")), labels.select("question_id", verdict.alias("verdict")), "difficulty")


RUNS = "a AS (SELECT o_custkey AS c, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS c, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1), j AS (SELECT c, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS jaccard, a.s = b.s AS identical, len(list_filter(a.s, lambda x: NOT list_contains(b.s, x))) AS only_a FROM a JOIN b USING (c))"


@query(f"WITH {RUNS} SELECT c AS o_custkey, round(jaccard, 6) AS jaccard, identical, only_a FROM j")
def a18_jaccard(spark, sf):
    o = table(spark, sf, "orders")
    found = E.agreement(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderpriority")
    return found.select("o_custkey", F.round("jaccard", 6).alias("jaccard"), "identical", "only_a")


@query("WITH a AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 2 = 1) SELECT c, 'a' AS run FROM a WHERE c NOT IN (SELECT c FROM b) UNION ALL SELECT c, 'b' FROM b WHERE c NOT IN (SELECT c FROM a)")
def j16_unpaired(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 2).alias("odd"))
    return E.unpaired(o.where("odd = 0"), o.where("odd = 1"), "c")


@query("WITH n AS (SELECT o_custkey % 5 AS run, o_custkey, count(*) AS k FROM orders GROUP BY ALL) SELECT run, round(avg(k), 6) AS mean, median(k) AS median, max(k) AS most, sum(k) AS total FROM n GROUP BY run")
def a19_inflation(spark, sf):
    runs = table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("run"), F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("class_id"))
    return E.class_counts(runs).select("run", F.round("mean", 6).alias("mean"), "median", "most", "total")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT user_id, list(event_type ORDER BY n DESC, event_type) AS ranking FROM c GROUP BY 1), p AS (SELECT list_position(ranking, 'click') AS a, list_position(ranking, 'view') AS b FROM r)
    SELECT count_if(a < b) AS a_first, count_if(a > b) AS b_first, count_if(abs(a - b) = 1) AS adjacent, round(abs(count_if(a < b) - count_if(a > b)) / count(*), 6) AS skew FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def a20_rank_control(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    rankings = c.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))), lambda s: s["event_type"]).alias("ranking"))
    return E.rank_control(rankings, "click", "view")


@query("""WITH c AS (SELECT conv_id, unnest([conv_id * 3, conv_id * 11]) AS id FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT conv_id, count(*) AS cited, count_if(doc_id IS NULL) AS unresolvable, count_if(lang = 'en') AS grounded FROM c LEFT JOIN documents ON id = doc_id GROUP BY conv_id""")
def a21_citations(spark, sf):
    cited = table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(F.col("conv_id") * 3, F.col("conv_id") * 11)).alias("doc_id"))
    met = cited.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "left")
    return met.groupBy("conv_id").agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.col("lang").isNull()).alias("unresolvable"), F.count_if(F.coalesce(F.col("lang") == "en", F.lit(False))).alias("grounded"))


@query(rf"""WITH t AS (SELECT DISTINCT item_id AS "case", unnest({SQL_TOKENS}) AS term FROM benchmark), u AS (SELECT doc_id, unnest(list_distinct({SQL_TOKENS})) AS term FROM documents), s AS (SELECT "case", doc_id AS unit, count(*) AS shared FROM t JOIN u USING (term) GROUP BY ALL)
    SELECT "case", unit, shared, CASE WHEN shared >= 3 THEN 'REVIEW' ELSE 'novel' END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY shared DESC, unit) AS r FROM s) WHERE r = 1""")
def j18_novelty(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("case"), F.explode(X.tokens("text")).alias("term"))
    units = table(spark, sf, "documents").select(F.col("doc_id").alias("unit"), F.col("doc_id").alias("ord"), X.tokens("text").alias("words"))
    return E.novelty(terms, units)


PROPOSED = [("c1", "K22"), ("c1", "K1"), ("c2", "K7"), ("c2", "K21"), ("c3", "K55")]
CONSIDERED = [("c1", "K22", "K21"), ("c2", "K7", "K12"), ("c2", "K21", "K22"), ("c3", "K55", "K53"), ("c3", "K55", "K18")]


@query(f"""WITH e AS (SELECT * FROM {sql_values(EDGES, 'child', 'parent')}), s AS (SELECT DISTINCT a.child AS id, b.child AS sibling FROM e a JOIN e b ON a.parent = b.parent AND a.child <> b.child), p AS (SELECT DISTINCT * FROM {sql_values(PROPOSED, '"case"', 'class_id')}), c AS (SELECT * FROM {sql_values(CONSIDERED, '"case"', 'class_id', 'sibling')})
    SELECT p."case", count_if(EXISTS (SELECT 1 FROM c JOIN s ON s.id = c.class_id AND s.sibling = c.sibling WHERE c."case" = p."case" AND c.class_id = p.class_id)) AS ok, count(*) AS total FROM p WHERE class_id IN (SELECT id FROM s) GROUP BY 1""")
def a23_siblings(spark, sf):
    return E.sibling_compliance(values(spark, "case string, class_id string", PROPOSED), H.siblings(model(spark).class_edges, model(spark).classes), values(spark, "case string, class_id string, sibling string", CONSIDERED))


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand AS label, p_type AS reading FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c) WHERE r = 1")
def a24_most_frequent_reading(spark, sf):
    from ..operators.corpus import majority

    return majority(table(spark, sf, "part"), "p_brand", "p_type").select(F.col("p_brand").alias("label"), F.col("p_type").alias("reading"))


@query("SELECT concat(conv_id, '-q', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS question_id, role AS difficulty FROM conversations WHERE length(text) > 100")
def r8_question_merge(spark, sf):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").where(F.length("text") > 100).select(F.concat(F.col("conv_id").cast("string"), F.lit("-q"), n.cast("string")).alias("question_id"), F.col("role").alias("difficulty"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) // 8 AS bundle, lang FROM labels LEFT JOIN documents USING (doc_id)")
def r9_bundles(spark, sf):
    own = E.bundles(table(spark, sf, "labels"), "quality", "doc_id").select("doc_id", "bundle")
    return own.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "left")


@query("SELECT coalesce(role, 'all') AS case_id, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY ROLLUP (role)")
def r12_case_rollup(spark, sf):
    return E.case_totals(table(spark, sf, "conversations"), "role", n=F.count(F.lit(1)), chars=F.sum(F.length("text")))


@query("SELECT CASE WHEN lower(trim(o_orderpriority)) LIKE '%urgent%' THEN 'high' WHEN lower(o_orderpriority) LIKE '%low%' THEN 'low' ELSE 'unknown' END AS value, count_if(NOT (lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderpriority) LIKE '%low%')) AS coerced, count(*) AS n FROM orders GROUP BY 1")
def x41_enum_coercion(spark, sf):
    p = F.lower(F.trim("o_orderpriority"))
    value = F.when(p.like("%urgent%"), "high").when(p.like("%low%"), "low").otherwise("unknown")
    return table(spark, sf, "orders").select(value.alias("value")).groupBy("value").agg(F.count_if(F.col("value") == "unknown").alias("coerced"), F.count(F.lit(1)).alias("n"))
