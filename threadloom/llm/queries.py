"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.worktables import spread
from .decontamination import contamination
from .exact_dedup import exact_duplicates
from .language_id import fit, identify
from .license_scan import license_digest, scan_licenses
from .lm_score import score_documents
from .packing import pack
from .secret_scan import scan_secrets, secret_digest
from .sharding import uniform_shards
from .simhash import near_duplicates
from .token_counts import length_histogram, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_counts(_documents(spark, sf_dir)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return identify(docs, fit(docs))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(_documents(spark, sf_dir)))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(_documents(spark, sf_dir)))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_shards(_documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_packing, op4_language_id, op5_licenses, op6_secrets, op7_shards, op8_decontamination, op9_lm_score, op10_exact_dedup)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op8_decontamination": f"""
        WITH d AS (SELECT rowid AS r, doc_id, {_WORDS} AS w FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
        i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
        s AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0),
        k AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + 9], ' ') AS k FROM s),
        t AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d),
        g AS (SELECT r, p, list(w) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM t),
        x AS MATERIALIZED (SELECT r, p, n, array_to_string(g[1:n], ' ') AS k FROM g, (SELECT DISTINCT n FROM k) WHERE len(g) >= n),
        m AS (SELECT r, p, n, item_id FROM x JOIN k USING (n, k)),
        h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
        c AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN c USING (r)""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
