"""Uniform sharding by a hypergeometric communication matrix.

Rows of input partition p that go to column c (a block of a shard) are counted by an exact draw from the multivariate
hypergeometric law with the partition sizes as row sums and the block sizes as column sums. A partition permutes
its rows, cuts them by its row of the matrix and sends them off; each block permutes what it received. Together
that is a uniform random permutation of all rows with shard sizes that differ by at most one.

The matrix is never stored. It is the leaves of a binary tree over the partitions: at each node the column sums of the
left half are drawn by a generator that is seeded by the node, so a task computes its own row in log(partitions)
steps from the prefix sums of the partition sizes alone.

Defined cases: null and empty text has no bytes (size 8, crc 0); a very long text is one row like any other; null or repeated
doc_id are rows like any other; rows are placed by position, so repeated rows and ties get slots of their own; an empty
table gives an empty result; further columns, whatever their names, are not read, and write_shards keeps them (its own columns
shard and slot get underscores behind them where the table has such names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise, quoted, to_arrow_schema, whole_row

SHARDS = 24
#: Rows of one block at most: one task permutes a block.
BLOCK_ROWS = 500_000
#: Bound on the input partitions, whose sizes (8 bytes each) go to every task.
MOST_PARTITIONS = 4_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Successes among n draws without replacement; for populations beyond numpy's limit by inversion around the mode."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * (good / total)
    spread = math.sqrt(max(1.0, mean * (bad / total) * ((total - n) / (total - 1))))
    low, high = max(0, n - bad), min(n, good)
    a, b = max(low, math.floor(mean - 12 * spread) - 12), min(high, math.ceil(mean + 12 * spread) + 12)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def split(rng: np.random.Generator, columns: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of n drawn rows belong to each column."""
    if int(columns.sum()) < 1_000_000_000:
        return rng.multivariate_hypergeometric(columns, n, method="marginals")
    out, rest = np.zeros_like(columns), int(columns.sum())
    for c, size in enumerate(columns.tolist()):
        rest -= size
        out[c] = k = hypergeometric(rng, size, rest, n)
        n -= k
        if not n:
            break
    return out


def matrix_row(prefix: np.ndarray, columns: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the matrix. prefix: sums of the partition sizes before each partition, and the total."""
    low, high = 0, len(prefix) - 1
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 1, low, high])))
        left = split(rng, columns, int(prefix[middle] - prefix[low]))
        low, high, columns = (low, middle, left) if p < middle else (middle, high, columns - left)
    return columns


def even(total: int, parts: int) -> np.ndarray:
    return np.array([total // parts + (i < total % parts) for i in range(parts)], dtype=np.int64)


def block_sizes(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all blocks, shard by shard, and the shard of each block."""
    sizes = [even(int(n), max(1, -(-int(n) // block_rows))) for n in even(rows, shards)]
    return np.concatenate(sizes), np.repeat(np.arange(shards), [len(s) for s in sizes])


def _number(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Adds the row's place in its partition."""
    at = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows, dtype=np.int64))], schema=schema)
        at += b.num_rows


def _send(batches: Iterator[pa.RecordBatch], schema: pa.Schema, pids: np.ndarray, prefix: np.ndarray, columns: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    """Adds the block of each row: its place in the permuted partition, cut by the matrix row."""
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        pid, at = b.column("pid").to_numpy(), b.column("at").to_numpy()
        block = np.empty(len(pid), np.int32)
        for p in np.unique(pid).tolist():
            k = int(np.searchsorted(pids, p))
            if p not in known:
                if len(known) > 8:
                    known.clear()
                order = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 2, k]))).permutation(int(prefix[k + 1] - prefix[k]))
                known[p] = order, np.cumsum(matrix_row(prefix, columns, k, seed))
            order, ends = known[p]
            own = pid == p
            block[own] = np.searchsorted(ends, order[at[own]], side="right")
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], schema=schema)


def uniform_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 7, block_rows: int = BLOCK_ROWS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    if shards < 1 or block_rows < 1:
        raise ValueError("shards and block_rows are at least 1")
    spark, text = docs.sparkSession, F.coalesce(F.col(quoted(text_col)).cast("binary"), F.lit(b""))
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.spark_partition_id().alias("pid"))
    numbered = T.StructType().add("doc_id", "long").add("size", "long").add("text_crc32", "long").add("pid", "integer").add("at", "long")
    arrow = to_arrow_schema(numbered)
    rows = materialise(slim.mapInArrow(lambda it: _number(it, arrow), numbered), "shards")

    counts = rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).orderBy("pid").toPandas()  # one row per input partition
    if len(counts) > MOST_PARTITIONS:
        raise ValueError(f"{len(counts)} input partitions; coalesce the input to {MOST_PARTITIONS} at most")
    pids, prefix = counts["pid"].to_numpy(np.int64), np.concatenate([[0], np.cumsum(counts["n"].to_numpy(np.int64))])
    columns, shard_of = block_sizes(int(prefix[-1]), shards, block_rows)
    starts = np.cumsum(columns) - columns
    first = {s: int(starts[np.argmax(shard_of == s)]) for s in range(shards)}

    dealt = T.StructType(list(numbered.fields)).add("block", "integer")
    sent_schema, given = to_arrow_schema(dealt), spark.sparkContext.broadcast((pids, prefix, columns))
    sent = rows.mapInArrow(lambda it: _send(it, sent_schema, *given.value, seed), dealt)

    out = T.StructType().add("doc_id", "long").add("size", "long").add("text_crc32", "long").add("law", "string").add("shard", "integer").add("slot", "long").add("grown_shard", "integer")
    out_schema = to_arrow_schema(out)
    bases = {int(b): (int(shard_of[b]), int(starts[b]) - first[int(shard_of[b])]) for b in range(len(columns))}

    def permute(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        shard, base = bases[block]
        table = table.sort_by([("pid", "ascending"), ("at", "ascending")])  # the same whichever order the rows came in
        slot = base + np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 3, block]))).permutation(table.num_rows)
        n = table.num_rows
        return pa.Table.from_arrays([table.column("doc_id"), table.column("size"), table.column("text_crc32"), pa.array(["rows"] * n), pa.array(np.full(n, shard, np.int32)), pa.array(slot.astype(np.int64)), pa.nulls(n, pa.int32())], schema=out_schema)

    return sent.groupBy("block").applyInArrow(permute, out)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 7, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write whole rows as path/shard=k, in slot order within each file, beside their slot. Needs unique, non-null ids."""
    if docs.where(F.col(quoted(id_col)).isNull()).limit(1).count() or docs.groupBy(quoted(id_col)).count().where("count > 1").limit(1).count():
        raise ValueError(f"{id_col} must be unique and not null to join placements to rows")
    place = uniform_shards(docs, shards, seed, text_col=text_col, id_col=id_col).select("doc_id", "shard", "slot")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), whole_row(docs).alias("row")).join(place, "doc_id")
    rows = rows.repartition("shard", (F.col("slot") / BLOCK_ROWS).cast("long")).sortWithinPartitions("shard", "slot")
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("slot").alias(slot), F.col("shard").alias(shard)).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.parquet(path)


