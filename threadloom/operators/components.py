"""Connected components by alternating large-star and small-star steps.

Each round is two exchanges on edges; the number of rounds grows with the logarithm of the largest component. Nodes
and edges never come to the driver: a round reports only one number. Hubs: a star step keeps at most one edge per
node and neighbour, duplicates are folded before each exchange, and a group-by with min() combines on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .worktables import materialise

EDGE = T.StructType().add("a", "long").add("b", "long")
MOST_ROUNDS = 60


def _contract(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Within a task: edges become stars about the least node of what is connected here. Never more edges than before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
        if len(parent) > most:
            yield stars()
            parent.clear()
    yield stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: neighbours above a node link to the least of its neighbourhood; small: those below do, and the node itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least) for every node of the edges (a, b); least is the smallest node that it reaches."""
    schema = to_arrow_schema(EDGE)
    now = materialise(edges.select("a", "b").where("a <> b").mapInArrow(lambda it: _contract(it, schema), EDGE).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct())
        before = state
        now = materialise(_star(_star(now, large=True), large=False), "edges")
    raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")
