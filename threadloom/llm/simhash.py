"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits, so of two fingerprints that differ in at most three bits one
segment differs in at most one. Each segment is indexed under its 32 one-wildcard variants; equal variants meet and
candidates are verified by their whole distance. Distinct fingerprints only are indexed, so copies cost nothing.

A variant that more than HOT_ROWS fingerprints share is not compared pair by pair: its rows are dealt anew by
one-wildcard variants of what they don't share yet (the other 32 bits as two halves of 16, then 16 as two of 8). After
that at most 11 bits are free, so a group has a proven bound of 2,048. Each group emits a spanning forest of its links,
never all pairs, which keeps every component.

Defined cases: null, empty and wordless text has fingerprint zero and links like any other; one or two words form one
shingle; very long texts are counted whole, some shingles at a time; a bit that exactly half the hashes set is 0; repeated rows
share a component; a component without any doc_id has component_id null, and of rows that tie for its smallest doc_id one
stays; an empty table gives an empty result; further columns, whatever their names, are kept by drop_near_duplicates and not
read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import chunks, materialise, quoted, row_type, texts_of, to_arrow_schema, whole_row
from .words import tokens

SHINGLE = 3
DISTANCE = 3
SEED = 42
HOT_ROWS = 1024
SHINGLE_BYTES = 3 << 20  # of text at once: a shingle takes 64 bytes while its bits are counted


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    own = tokens(text)
    if not own:
        return []
    joined = b" ".join(own)
    if len(own) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:z], SEED) for a, z in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A bit is set if it is set in over half of the shingles' hashes."""
    lists = [shingle_hashes(t) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        every = np.array([h for x in lists for h in x], np.uint64)
        bits = np.unpackbits(every.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > counts[full][:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()
    return out


def _print(batches: Iterator[pa.RecordBatch], schema: pa.Schema, text: str) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, SHINGLE_BYTES):
        payload = batch.column("payload")
        found = fingerprints(texts_of(payload.field(text) if pa.types.is_struct(payload.type) else payload))
        columns = [batch.column("uid"), batch.column("doc_id"), pa.array(found.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns + ([payload] if len(schema) > 3 else []), schema=schema)


def _forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a group of distinct fingerprints."""
    if len(prints) == 2:
        return [(0, 1)] if int(prints[0] ^ prints[1]).bit_count() <= distance else []
    left, out = np.arange(len(prints)), []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            a = todo.pop()
            near = np.bitwise_count(prints[left] ^ prints[a]) <= distance
            out += [(a, int(b)) for b in left[near]]
            todo += left[near].tolist()
            left = left[~near]
    return out


def _variants(prints: np.ndarray, key: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """New keys for the rows of a hot group: one-wildcard variants of the bits that the key leaves open.

    A key of level 1 is variant << 32 | masked segment; variant >> 5 tells the segment that it holds. Keys of deeper
    levels are hashes of what they hold, with the part that is still open in the two lowest bits.
    """
    if level == 1:
        shift = np.uint64(0 if (key >> 37) & 1 else 32)
        width = 16
    else:
        shift = np.uint64(16 * (key & 3))
        width = 8
    keys, owners = [], []
    for half in (0, 1):
        part = (prints >> (shift + np.uint64(half * width))) & np.uint64((1 << width) - 1)
        still_open = int(shift) // 16 + (1 - half) if level == 1 else 0
        for bit in range(width):
            value = part & ~np.uint64(1 << bit)
            seed = xxhash.xxh64_intdigest(f"{key}/{level}/{half}/{bit}".encode())
            mixed = (value + np.uint64(seed & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed)
            keys.append((mixed & ~np.uint64(3)) | np.uint64(still_open))
            owners.append(prints)
    return np.concatenate(keys), np.concatenate(owners)


def _link(batches: Iterator[pa.RecordBatch], schema: pa.Schema, level: int, distance: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Gives links (true, a, b) and, for hot groups, rows to deal anew (false, key, fingerprint)."""

    def rows(flag: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), flag)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    held, held_key, over = np.zeros(0, np.uint64), None, False

    def settle() -> Iterator[pa.RecordBatch]:
        if held_key is not None and not over and len(held) > 1:
            own = np.unique(held)
            if pairs := _forest(own, distance):
                at = np.array(pairs)
                yield rows(True, own[at[:, 0]], own[at[:, 1]])

    for batch in batches:
        keys, prints = batch.column("key").to_numpy(), batch.column("print").to_numpy().view(np.uint64)
        if not len(keys):
            continue
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        ends = np.concatenate([starts[1:], [len(keys)]])
        # groups that lie whole within the batch: those of one row give nothing, those of two are verified together
        inner = np.arange(1, len(starts) - 1)
        two = inner[(ends - starts)[inner] == 2]
        a, b = prints[starts[two]], prints[starts[two] + 1]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        if near.any():
            yield rows(True, a[near], b[near])
        for g in [0, *inner[(ends - starts)[inner] > 2].tolist(), *([len(starts) - 1] if len(starts) > 1 else [])]:
            key, own = int(keys[starts[g]]), prints[starts[g] : ends[g]]
            if key != held_key:
                yield from settle()
                held, held_key, over = own, key, False
            elif not over:
                held = np.concatenate([held, own])
            if level < 3 and (over or len(held) > hot):
                yield rows(False, *_variants(own if over else held, key, level))
                held, over = np.zeros(0, np.uint64), True
    yield from settle()


def links(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT_ROWS) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints within the distance into one component. prints: distinct `print`."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard find distances up to 3")
    variant = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")
    segment = F.expr("shiftrightunsigned(print, CASE WHEN v < 32 THEN 0 ELSE 32 END) & 4294967295L")
    keyed = prints.select("print", variant).select((F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(segment.bitwiseAND(F.expr("~shiftleft(1L, v % 32)")))).alias("key"), "print")
    out = T.StructType().add("link", "boolean").add("a", "long").add("b", "long")
    schema, found = to_arrow_schema(out), None
    for level in (1, 2, 3):
        dealt = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it, level=level: _link(it, schema, level, distance, hot), out)
        got = materialise(dealt, "links")
        edges = got.where("link").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        rest = got.where("NOT link").select(F.col("a").alias("key"), F.col("b").alias("print"))
        if level == 3 or rest.isEmpty():
            return found
        keyed = rest
    return found


def _classes(printed: DataFrame) -> DataFrame:
    """print -> component_id and keep_uid (row of the component's smallest doc_id, a null one last)."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best")
    distinct = materialise(printed.groupBy("print").agg(best), "prints")
    found = components(links(distinct.select("print")))
    known = distinct.join(found, distinct["print"] == found["node"]).select("print", "best", "least")
    least = known.groupBy("least").agg(F.min("best").alias("first"))
    joined = known.join(least, "least").select(F.col("print").alias("linked"), "first")
    every = distinct.join(joined, distinct["print"] == joined["linked"], "left").select("print", F.coalesce("first", "best").alias("first"))
    return materialise(every.select("print", F.col("first.doc_id").alias("component_id"), F.col("first.uid").alias("keep_uid")), "classes")


def _printed(docs: DataFrame, text_col: str, id_col: str, rows: bool) -> DataFrame:
    out = T.StructType().add("uid", "long").add("doc_id", "long").add("print", "long")
    if rows:
        out.add("payload", row_type(docs))
    schema = to_arrow_schema(out)
    slim = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(quoted(id_col)).cast("long").alias("doc_id"), (whole_row(docs) if rows else F.col(quoted(text_col))).alias("payload"))
    return materialise(slim.mapInArrow(lambda it: _print(it, schema, text_col), out), "simhash")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    printed = _printed(docs, text_col, id_col, rows=False)
    found = printed.join(_classes(printed), "print")
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The row with the smallest doc_id of each component, with all its columns."""
    printed = _printed(docs, text_col, id_col, rows=True)
    kept = _classes(printed).select(F.col("keep_uid").alias("uid")).distinct()
    return printed.join(kept, "uid", "left_semi").select(*[F.col("payload").getField(c).alias(c) for c in docs.columns])
