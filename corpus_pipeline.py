"""A training-data pipeline of five stages: what one stage returns is written and is all that the next one reads.

STAGES lists (name, function); each function takes (spark, docs, sf_dir). All but the last return the columns of
documents. run() applies them to the whole documents table, in the shared work folder.

Defined cases of every stage: null and empty texts have no letters, so language_id drops them; later stages, given such rows,
treat them as equal to each other (exact_dedup), as near copies of each other (near_dedup), as clean (decontamination) and as
the end token alone (packing). Very long texts are worked on whole. Of repeated rows and ties exactly one row stays in the two
deduplicating stages. An empty table stays empty. Further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.common import materialise
from threadloom.llm.decontamination import drop_contaminated
from threadloom.llm.exact_dedup import drop_exact_duplicates
from threadloom.llm.language_id import drop_rejected, fit
from threadloom.llm.packing import pack
from threadloom.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents for which no language is accepted."""
    return drop_rejected(docs, fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts: the row with the largest doc_id."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates: the smallest doc_id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the pieces of every document that is left in sequences."""
    return pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]

#: Character models, fingerprints and a subword tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
