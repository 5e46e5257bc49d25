"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: each segment of about SEGMENT_BYTES of text stores its terms, their document-ordered
token positions (delta coded) and where each document begins, one Parquet row per segment. Building it needs no
exchange, so no frequent word gathers anywhere. A search sends the benchmark's windows to all segments: a window
with a term that a segment lacks ends there; of the others the offset-adjusted position lists are intersected from
the rarest term on. Phrases match exactly; with a slop, terms must follow each other in order within that many
extra words (proximity).

The benchmark is broadcast only up to ITEM_BYTES of text; a larger one is searched in blocks of that size.

Defined cases: null, empty or wordless text has no words, no hits and isn't contaminated; wordless items have no windows;
repeated items count once by id; a null item id counts as the id ""; repeated documents are each judged; a very long text
makes a segment of its own and is searched whole; terms that are equally rare are taken in the order of the window; an empty
benchmark contaminates nothing, and an empty table gives an empty result; further columns, whatever their names, are kept by
drop_contaminated and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialise, quoted, texts_of, to_arrow_schema, whole_row
from .words import words

WINDOW = 10
SEGMENT_BYTES = 4 << 20
#: Benchmark text that is broadcast at once.
ITEM_BYTES = 24 << 20

INDEX = T.StructType().add("segment", "string").add("doc_ids", T.ArrayType(T.LongType())).add("keys", T.ArrayType(T.LongType())).add("lengths", "binary").add("terms", "binary").add("counts", "binary").add("deltas", "binary")
SPAN = T.StructType().add("item_id", "string").add("start", "long").add("end", "long")
DIGEST = T.StructType().add("doc_id", "long").add("key", "long").add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")
HITS = T.StructType().add("segment", "string").add("place", "integer").add("doc_id", "long").add("key", "long").add("n_words", "long").add("spans", T.ArrayType(SPAN))


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for number, batch in enumerate(chunks(batches, SEGMENT_BYTES)):
        lists = [words(t) for t in texts_of(batch.column("text"))]
        lengths = np.array([len(x) for x in lists], np.int64)
        code: defaultdict[bytes, int] = defaultdict()
        code.default_factory = code.__len__
        codes = np.fromiter(map(code.__getitem__, chain.from_iterable(lists)), np.int32, int(lengths.sum()))
        positions = np.argsort(codes, kind="stable").astype(np.int32)
        counts = np.bincount(codes, minlength=len(code)).astype(np.int32)
        deltas = np.diff(positions, prepend=np.int32(0)).astype(np.int32)
        row = [[f"{task}-{number}"], [batch.column("doc_id").to_pylist()], [batch.column("key").to_pylist()], [lengths.tobytes()], [b" ".join(code)], [counts.tobytes()], [deltas.tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store the index of all tokens. key: a hash of the text, which with doc_id finds a row again."""
    schema = to_arrow_schema(INDEX)
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(F.col(quoted(text_col))).alias("key"), F.col(quoted(text_col)).alias("text"))
    return materialise(slim.mapInArrow(lambda it: _segments(it, schema), INDEX), "index")


class Windows:
    """The windows of some items: by length, a matrix of term numbers and the item of each row."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.terms: dict[bytes, int] = {}
        self.ids: list[str] = []
        rows: dict[int, tuple[list[list[int]], list[int]]] = {}
        for item, text in items:
            codes = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            if not codes:
                continue
            self.ids.append(item)
            size = min(window, len(codes))
            matrix, owner = rows.setdefault(size, ([], []))
            matrix += [codes[i : i + size] for i in range(len(codes) - size + 1)]
            owner += [len(self.ids) - 1] * (len(codes) - size + 1)
        self.rows = [(size, np.array(m, np.int32), np.array(o, np.int32)) for size, (m, o) in sorted(rows.items())]


def _exact(lists: list[np.ndarray]) -> np.ndarray:
    """Starts at which list j holds start + j for each j, taking the lists from the shortest on."""
    order = sorted(range(len(lists)), key=lambda j: len(lists[j]))
    starts = lists[order[0]] - order[0]
    for j in order[1:]:
        at = np.searchsorted(lists[j], starts + j)
        at[at == len(lists[j])] = 0
        starts = starts[lists[j][at] == starts + j]
        if not len(starts):
            break
    return starts


def _near(lists: list[np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends where the terms follow in order within len + slop words: from each start the nearest next."""
    starts = ends = lists[0]
    for x in lists[1:]:
        at = np.searchsorted(x, ends, side="right")
        ok = at < len(x)
        starts, ends = starts[ok], x[at[ok]]
        ok = ends - starts < len(lists) + slop
        starts, ends = starts[ok], ends[ok]
    return starts, ends


def _search_segment(found: Windows, terms: bytes, counts: np.ndarray, deltas: np.ndarray, lengths: np.ndarray, slop: int) -> dict[int, dict[int, list[tuple[int, int]]]]:
    """By document and item, the spans of matches from the document's word 0, in order and merged."""
    own = np.full(len(found.terms), -1, np.int64)
    for k, term in enumerate(terms.split()):
        if (q := found.terms.get(term)) is not None:
            own[q] = k
    ends = np.cumsum(counts, dtype=np.int64)
    here = np.where(own >= 0, counts[own] if len(counts) else 0, 0)
    doc_end = np.cumsum(lengths)
    positions = None
    hits: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for size, matrix, owner in found.rows:
        for r in np.flatnonzero(here[matrix].min(axis=1) > 0) if len(matrix) else ():
            if positions is None:
                positions = np.cumsum(deltas, dtype=np.int64)
            lists = [positions[ends[k] - counts[k] : ends[k]] for k in own[matrix[r]]]
            start, last = (s := _exact(lists), s + size - 1) if not slop else _near(lists, slop)
            if not len(start):
                continue
            doc = np.searchsorted(doc_end, start, side="right")
            whole = doc == np.searchsorted(doc_end, last, side="right")
            for d, a, z in zip(doc[whole].tolist(), start[whole].tolist(), last[whole].tolist(), strict=True):
                base = int(doc_end[d] - lengths[d])
                hits.setdefault(d, {}).setdefault(int(owner[r]), []).append((a - base, z - base + 1))
    return hits


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals as ordered ones; those that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _search(batches: Iterator[pa.RecordBatch], schema: pa.Schema, found: Windows, slop: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            segment, ids, keys, lengths, terms, counts, deltas = (batch.column(c)[r].as_py() for c in INDEX.names)
            n = np.frombuffer(lengths, np.int64)
            hits = _search_segment(found, terms, np.frombuffer(counts, np.int32), np.frombuffer(deltas, np.int32), n, slop)
            spans = [[{"item_id": found.ids[i], "start": a, "end": z} for i, s in sorted(hits[d].items()) for a, z in merged(s)] if d in hits else [] for d in range(len(ids))]
            columns = [[segment] * len(ids), range(len(ids)), ids, keys, n, spans]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, text_col: str = "text", id_col: str = "item_id", item_bytes: int = ITEM_BYTES, digest: bool = False) -> DataFrame:
    """One row per document with the merged spans of each item's matching windows (digest: with their digest instead).

    The digest of a benchmark of one block is made in the worker that searches, so a task needs one Python worker.
    """
    spark = index.sparkSession
    slim = items.select(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // item_bytes) if size > item_bytes else 1)
    schema, digest_schema, parts = to_arrow_schema(HITS), to_arrow_schema(DIGEST), []
    for b in range(blocks):
        block = slim.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else slim
        found = Windows([(r.id, r.text.encode()) for r in block.distinct().orderBy("id", "text").toLocalIterator()], window)
        given = spark.sparkContext.broadcast(found)
        if digest and blocks == 1:
            return index.mapInArrow(lambda it, given=given: _digest(_search(it, schema, given.value, slop), digest_schema), DIGEST)
        parts.append(index.mapInArrow(lambda it, given=given: _search(it, schema, given.value, slop), HITS))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    one = lambda c: F.first(c).alias(c)
    whole = every.groupBy("segment", "place").agg(one("doc_id"), one("key"), one("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
    return whole.mapInArrow(lambda it: _digest(it, digest_schema), DIGEST) if digest else whole


def _digest(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n_hit, n_items, digest = [], [], []
        for spans in batch.column("spans").to_pylist():
            ids = sorted({s["item_id"] for s in spans}) if spans else []
            n_hit.append(sum(z - a for a, z in merged([(s["start"], s["end"]) for s in spans])) if spans else 0)
            n_items.append(len(ids))
            digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest() if ids else none)
        columns = [batch.column("doc_id"), batch.column("key"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest), pa.array([x > 0 for x in n_hit])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated."""
    return search(build_index(docs, text_col, id_col), items, window, digest=True)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    bad = contamination(docs, items, window, text_col, id_col).where("contaminated").select("doc_id", "key").distinct()
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("own_id"), F.xxhash64(quoted(text_col)).alias("own_key"), whole_row(docs).alias("row"))
    kept = rows.join(bad, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("key")), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
