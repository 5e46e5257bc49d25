"""Exact search among vectors: the best of each query, the best in each group, and places in the whole order.

Queries and vectors are dealt to a grid of groups; a group multiplies matrices and orders whole rows of one query at a time, so
nothing but answers leaves it and its memory is bounded by VECTORS and QUERIES. The order is that of `ranked`: by the score
rounded to `digits` places, then by id; null scores come last. What float sums leave open at a rounding boundary is summed
again in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

VECTORS, QUERIES = 100_000, 8_000  # of a group, about
TOGETHER, LANES = 64, 64  # queries multiplied at once, and vectors of which one maximum is kept
LAST = 1 << 30


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal width and the length of each (-1: null, or it holds a null)."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    wide, ends = int(sizes.max(initial=1)), np.cumsum(sizes)
    values, out = pc.fill_null(flat, 0.0).to_numpy(), np.zeros((len(lists), max(1, wide)))
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = values
    if lists.null_count:
        sizes[~lists.is_valid().to_numpy(zero_copy_only=False)] = -1
    if flat.null_count:
        sizes[rows[~flat.is_valid().to_numpy(zero_copy_only=False)]] = -1
    return out, sizes


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums in the order of the elements, as the engine has them."""
    total = np.zeros(len(b))
    for k in range(b.shape[1]):
        total += a[..., k] * b[:, k]
    return total


class _Block:
    """The vectors of a group in the order of their ids, and the keys by which a query orders them (the least is the best)."""

    def __init__(self, vectors: pa.Table, wide: int, digits: int):
        order = pc.sort_indices(vectors, [("id", "ascending")])
        self.table, self.digits = vectors.take(order), digits
        own, self.sizes = _matrix(self.table["own"])
        self.own = np.pad(own, ((0, 0), (0, max(0, wide - own.shape[1]))))
        self.places = np.arange(len(self.own), dtype=np.int64)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.own, self.own)).max(initial=0.0)

    def likely(self, asked: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Places among which the best `most` of each query are: all whose score in single precision could reach that of the last of
        them. Where widths differ or a value isn't finite, all places."""
        n, wide = self.own.shape
        lines, rough = n // LANES, self.own.astype(np.float32)
        alike = lines >= most and np.isfinite(self.norm) and self.norm < 1e3 and (self.sizes == self.sizes[0]).all()
        for begin in range(0, len(asked), TOGETHER):
            block, own = asked[begin : begin + TOGETHER], sizes[begin : begin + TOGETHER]
            norms = np.sqrt(np.einsum("ij,ij->i", block, block))
            if not (alike and (own == self.sizes[0]).all() and (norms < 1e3).all()):
                yield from [self.places] * len(block)
                continue
            scores = np.pad(block, ((0, 0), (0, wide - block.shape[1]))).astype(np.float32) @ rough.T
            highest = scores[:, : lines * LANES].reshape(len(block), LANES, lines).max(1)  # of `most` groups or more, so the last of these is no better than that of all
            error = (wide + 4) * 2.0**-23 * max(1.0, self.norm) * np.maximum(1.0, norms)
            least = np.partition(highest, lines - most, 1)[:, lines - most] - (2 * error + 2 * 10.0**-self.digits)
            for row, limit in zip(scores, least, strict=True):
                yield np.flatnonzero(row >= limit)

    def keys(self, query: np.ndarray, size: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        query = np.pad(query, (0, self.own.shape[1] - len(query)))
        own, sizes, places = self.own[at], self.sizes[at], self.places[at]
        scores, unit = own @ query, 10.0**self.digits
        scaled = np.abs(scores) * unit
        whole = np.floor(scaled + 0.5)
        for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-7):
            exact = Decimal(repr(float(_dots(query, own[i : i + 1])[0])))
            whole[i] = float(abs(exact).scaleb(self.digits).quantize(Decimal(1), ROUND_HALF_UP))
        strange = np.isnan(scores)
        worst = -np.where(strange, LAST, np.copysign(whole, scores)).astype(np.int64)
        worst[(sizes != size) | (sizes < 0)] = LAST
        return (worst << 32) | places

    def scores(self, query: np.ndarray, size: int, at: np.ndarray) -> list[float | None]:
        query = np.pad(query, (0, self.own.shape[1] - len(query)))
        return [float(s) if n == size and n >= 0 else None for s, n in zip(_dots(query, self.own[at]), self.sizes[at], strict=True)]


def _least(keys: np.ndarray, most: int) -> np.ndarray:
    return (np.partition(keys, most - 1)[:most] if most < len(keys) else keys) & 0xFFFFFFFF


@dataclass
class Dense:
    """Queries (query, vector) against vectors (id_col, vector_col)."""

    vectors: DataFrame
    queries: DataFrame
    id_col: str
    vector_col: str
    digits: int = 6

    def _own(self) -> DataFrame:
        from .search import unit

        return self.vectors.select(F.col(self.id_col).alias("id"), unit(F.col(self.vector_col)).alias("own"))

    def _asked(self) -> DataFrame:
        from .search import unit

        return self.queries.select("query", unit(F.col("vector")).alias("vector"))

    def _grid(self, own: DataFrame, asked: DataFrame, schema: T.StructType, rows: Callable[[_Block, np.ndarray, np.ndarray, pa.Table], dict]) -> DataFrame:
        n, m, cores = own.count(), asked.count(), own.sparkSession.sparkContext.defaultParallelism
        high = max(1, -(-n // VECTORS))
        wide = max(1, -(-m // QUERIES), -(-cores // high))
        deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
        copies = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        left = asked.select("*", deal("query", wide).alias("__g"), copies(high).alias("__h")).groupBy("__g", "__h")
        right = own.select("*", deal("id", high).alias("__h"), copies(wide).alias("__g")).groupBy("__g", "__h")
        arrow, digits = to_arrow_schema(schema), self.digits

        def group(queries: pa.Table, vectors: pa.Table) -> pa.Table:
            if not queries.num_rows or not vectors.num_rows:
                return arrow.empty_table()
            asked_rows, sizes = _matrix(queries["vector"])
            block = _Block(vectors, asked_rows.shape[1], digits)
            return pa.table(rows(block, asked_rows, sizes, queries), schema=arrow)

        return left.cogroup(right).applyInArrow(group, schema)

    def _kinds(self) -> list[T.StructField]:
        return [T.StructField("query", self.queries.schema["query"].dataType), T.StructField("id", self.vectors.schema[self.id_col].dataType)]

    def top(self, most: int) -> DataFrame:
        """query, id, score: the best `most` of every group, so at least those of the whole."""

        def rows(block, asked, sizes, queries):
            at, who, scores = [], [], []
            for q, (vector, size, likely) in enumerate(zip(asked, sizes, block.likely(asked, sizes, most), strict=True)):
                best = _least(block.keys(vector, size, slice(None) if likely is block.places else likely), most)
                at.append(best)
                who.append(np.full(len(best), q))
                scores += block.scores(vector, size, best)
            return {"query": queries["query"].take(pa.array(np.concatenate(who))), "id": block.table["id"].take(pa.array(np.concatenate(at))), "score": pa.array(scores, pa.float64())}

        return self._grid(self._own(), self._asked(), T.StructType([*self._kinds(), T.StructField("score", T.DoubleType())]), rows)

    def top_in(self, groups: DataFrame, most: int, whole: int) -> DataFrame:
        """query, id, score: the best `most` of every group of groups (id, part), or the best `whole` of the part ''."""

        def rows(block, asked, sizes, queries):
            at, who, scores = [], [], []
            part = block.table["part"].combine_chunks().dictionary_encode()
            part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
            codes, names = part.indices.to_numpy(), part.dictionary.to_pylist()
            order = np.argsort(codes, kind="stable")
            runs = [(r, whole if names[codes[r[0]]] == "" else most) for r in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)]
            for q, (vector, size) in enumerate(zip(asked, sizes, strict=True)):
                keys = block.keys(vector, size)
                best = np.concatenate([_least(keys[r], k) for r, k in runs])
                at.append(best)
                who.append(np.full(len(best), q))
                scores += block.scores(vector, size, best)
            return {"query": queries["query"].take(pa.array(np.concatenate(who))), "id": block.table["id"].take(pa.array(np.concatenate(at))), "score": pa.array(scores, pa.float64())}

        own = self._own().join(groups.select("id", F.coalesce(F.col("part").cast("string"), F.lit("\0")).alias("part")), "id")
        return self._grid(own, self._asked(), T.StructType([*self._kinds(), T.StructField("score", T.DoubleType())]), rows)

    def scored(self, pairs: DataFrame) -> DataFrame:
        """query, id, score of the pairs (query, id) that have both vectors."""
        dot = F.aggregate(F.zip_with("own", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return pairs.select("query", "id").distinct().join(self._own(), "id").join(self._asked(), "query").select("query", "id", dot.alias("score"))

    def ranks(self, scores: DataFrame) -> DataFrame:
        """query, id, rank of scores (query, id, score) in the query's order of all vectors; what one query asks for fits a row."""
        wanted = scores.groupBy("query").agg(F.collect_list(F.struct("id", "score")).alias("wanted"))
        kinds, unit, id_kind = self._kinds(), 10.0**self.digits, to_arrow_schema(T.StructType(self._kinds())).field("id").type

        def rows(block, asked, sizes, queries):
            who, named, better = [], [], []
            ids = block.table["id"].to_numpy()
            for q, (vector, size) in enumerate(zip(asked, sizes, strict=True)):
                keys = np.sort(block.keys(vector, size))
                own = queries["wanted"][q].values
                these = own.field("id")
                rounded = own.field("score").to_numpy(zero_copy_only=False)
                empty = ~own.field("score").is_valid().to_numpy(zero_copy_only=False)
                worst = np.where(empty, LAST, np.where(np.isnan(rounded), -LAST, -np.rint(np.nan_to_num(rounded) * unit))).astype(np.int64)
                places = np.searchsorted(ids, these.to_numpy(zero_copy_only=False)).astype(np.int64)
                better.append(np.searchsorted(keys, (worst << 32) + places))
                named.append(these)
                who.append(np.full(len(these), q))
            return {"query": queries["query"].take(pa.array(np.concatenate(who))), "id": pa.concat_arrays(named).cast(id_kind), "better": pa.array(np.concatenate(better), pa.int64())}

        rounded = wanted.withColumn("wanted", F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), F.round(w["score"], self.digits).alias("score"))))
        counted = self._grid(self._own(), self._asked().join(rounded, "query"), T.StructType([*kinds, T.StructField("better", T.LongType())]), rows)
        return counted.groupBy("query", "id").agg((F.sum("better") + 1).cast("int").alias("rank"))
