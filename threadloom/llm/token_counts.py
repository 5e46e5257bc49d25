"""Token counts as an exact length histogram.

Documents are aggregated by encoded length, so what follows has one row per distinct length, however many documents
there are. Suffix sums over the lengths then answer totals, quantiles and truncated totals for every context limit. They are
taken in two steps, over ranges of lengths and within each range, so no task gathers all lengths.

Defined cases: null and empty texts have 0 tokens and count as documents; very long texts are encoded whole; documents that tie
in length share a row; repeated rows count each; an empty table gives an empty histogram; further columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialise, quoted, texts_of, to_arrow_schema
from .encoder import default_path, encoder

RANGE = 1024  # lengths of one range


def _count(batches: Iterator[pa.RecordBatch], schema: pa.Schema, path: str) -> Iterator[pa.RecordBatch]:
    ids = encoder(path).ids
    for batch in chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(ids(t)) // 4 for t in texts_of(batch.column("text"))], pa.int64())], schema=schema)


def token_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every document."""
    out = T.StructType().add("doc_id", "long").add("n_tokens", "long")
    schema, path = to_arrow_schema(out), tokenizer or default_path()
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return slim.mapInArrow(lambda it: _count(it, schema, path), out)


def length_histogram(counts: DataFrame) -> DataFrame:
    """n_tokens, n_docs, docs_at_least, tokens_at_least, truncated_tokens (total if every document is cut to n_tokens)."""
    lengths = counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    lengths = materialise(lengths.withColumn("range", F.floor(F.col("n_tokens") / RANGE)), "lengths")  # so texts are encoded once
    tokens: Column = F.col("n_tokens") * F.col("n_docs")
    totals = lengths.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    above, all_ranges = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select("range", zero(F.sum("docs").over(above)).alias("docs_above"), zero(F.sum("tokens").over(above)).alias("tokens_above"), F.sum("tokens").over(all_ranges).alias("tokens_all"))
    within = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = lengths.join(totals, "range")
    docs_at, tokens_at = F.col("docs_above") + F.sum("n_docs").over(within), F.col("tokens_above") + F.sum(tokens).over(within)
    found = joined.select("n_tokens", "n_docs", docs_at.alias("docs_at_least"), tokens_at.alias("tokens_at_least"), "tokens_all")
    return found.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("tokens_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context, docs_over (longer than it), total_tokens, truncated_tokens for each limit: one pass that finds, for every limit, the suffix sums of the least length beyond it."""
    sums = F.struct("docs_at_least", "tokens_at_least")
    beyond = [F.min_by(sums, F.when(F.col("n_tokens") > x, F.col("n_tokens"))).alias(f"at{k}") for k, x in enumerate(limits)]
    found = histogram.agg(F.max("tokens_at_least").alias("total"), *beyond).where("total IS NOT NULL")  # one row
    over = lambda k, name: F.coalesce(F.col(f"at{k}.{name}"), F.lit(0).cast("long"))
    cut = lambda k, x: F.col("total") - over(k, "tokens_at_least") + over(k, "docs_at_least") * F.lit(x).cast("long")
    rows = [F.struct(F.lit(int(x)).cast("long").alias("context"), over(k, "docs_at_least").alias("docs_over"), F.col("total").alias("total_tokens"), cut(k, x).alias("truncated_tokens")) for k, x in enumerate(limits)]
    return found.select(F.inline(F.array(*rows)))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the least length that at least this share of the documents doesn't exceed."""
    total = histogram.agg(F.max("docs_at_least").alias("total"))  # one row
    asked = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    own = histogram.crossJoin(F.broadcast(total)).select("n_tokens", asked, (F.col("total") - F.col("docs_at_least") + F.col("n_docs")).alias("at_most"), "total")
    return own.where(F.col("at_most") >= F.col("share") * F.col("total")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
