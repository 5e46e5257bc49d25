"""Exact deduplication by Grace hashing.

Each map task first folds the copies that it can see, so a text that fills a third of the rows reaches the
exchange once per chunk of input, not once per row. What is left is dealt by content hash. A task then loads its
bucket into an open-addressing table that compares complete contents; as soon as the distinct contents outgrow
the memory bound, the bucket is partitioned into spill files by further hash bits and each part is taken the
same way, recursively.

Defined cases: null text equals empty text; of equal texts the row with the largest doc_id stays (a null doc_id
is smaller than any other; among rows that tie, exactly one stays); an empty table gives an empty result; columns
beside doc_id and text are carried along whatever their names; empty texts are equal to each other, and very long ones are
compared whole.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialise, quoted, row_type, texts_of, to_arrow_schema, whole_row

#: Distinct content bytes that one bucket may hold in memory before it is partitioned.
BUCKET_BYTES = 96 << 20
#: Input that a map task folds at once.
FOLD_BYTES = 16 << 20
FANOUT_BITS = 4
DEEPEST = 64 // FANOUT_BITS
NO_ID = -(1 << 63)
ROW_BYTES = 128  # that a bucket keeps of each row beside its content


class OpenTable:
    """Open addressing with linear probing; a slot holds the number of an entry, equality is of whole contents."""

    def __init__(self):
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def entry(self, h: int, content: bytes) -> tuple[int, bool]:
        """Number of the content's entry, and whether it is new."""
        at = h & self.mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            at = (at + 1) & self.mask
        self.slots[at] = e = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        if 2 * len(self.contents) > self.mask:
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.mask = 4 * self.mask + 3
        self.slots = [-1] * (self.mask + 1)
        for e, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = e


def _hash(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema, text: str | None) -> Iterator[pa.RecordBatch]:
    """Map side: one row per document; the best row of each group of copies in a chunk also carries the group."""
    for batch in chunks(batches, FOLD_BYTES):
        payload = batch.column("payload")
        contents = texts_of(payload.field(text) if text else payload)
        ids = [NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()]
        uids = batch.column("uid").to_pylist()
        table, best, count, of = OpenTable(), [], [], []
        for i, content in enumerate(contents):
            e, new = table.entry(_hash(content), content)
            if new:
                best.append(i)
                count.append(0)
            elif (ids[i], -uids[i]) > (ids[best[e]], -uids[best[e]]):
                best[e] = i
            count[e] += 1
            of.append(e)
        n = [0] * len(of)
        for e, i in enumerate(best):
            n[i] = count[e]
        rep = [uids[best[e]] for e in of]
        take = pa.array([i if n[i] else None for i in range(len(n))], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([_signed(table.hashes[e]) for e in of], pa.int64()), batch.column("uid"), pa.array(rep, pa.int64()), pa.array(n, pa.int64()), batch.column("doc_id"), payload.take(take)], schema=schema)


class _Bucket:
    """Representatives whose contents are in one table."""

    def __init__(self, text: str | None):
        self.text, self.table, self.bytes = text, OpenTable(), 0
        self.rep: list[int] = []
        self.ids: list[int] = []
        self.n: list[int] = []
        self.of: list[int] = []
        self.best: list[int] = []
        self.size: list[int] = []
        self.payload: list[pa.Array] = []

    def add(self, batch: pa.RecordBatch) -> None:
        payload = batch.column("payload")
        for i, (h, rep, n, doc, content) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("h", "rep", "n", "doc_id")), texts_of(payload.field(self.text) if self.text else payload), strict=True)):
            e, new = self.table.entry(h, content)
            k = len(self.rep)
            self.rep.append(rep)
            self.ids.append(NO_ID if doc is None else doc)
            self.n.append(n)
            self.of.append(e)
            self.bytes += ROW_BYTES
            if new:
                self.bytes += len(content)
                self.best.append(k)
                self.size.append(n)
                if self.text:
                    self.bytes += len(content)
                    self.payload.append(payload.take(pa.array([i])))
                continue
            self.size[e] += n
            b = self.best[e]
            if (self.ids[k], -rep) > (self.ids[b], -self.rep[b]):
                self.best[e] = k
                if self.text:
                    self.payload[e] = payload.take(pa.array([i]))

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The table's rows in the form in which they came, for a spill file; folded copies stay folded."""
        for at in range(0, len(self.rep), 256):
            part = range(at, min(at + 256, len(self.rep)))
            payload = pa.concat_arrays([self.payload[self.of[k]] for k in part]) if self.text else pa.array([self.table.contents[self.of[k]] for k in part], pa.binary()).cast(schema.field("payload").type)
            yield pa.RecordBatch.from_arrays([pa.array([self.table.hashes[self.of[k]] for k in part], pa.int64()), pa.array([self.rep[k] for k in part], pa.int64()), pa.array([self.n[k] for k in part], pa.int64()), pa.array([None if self.ids[k] == NO_ID else self.ids[k] for k in part], pa.int64()), payload], schema=schema)


def _parts(batch: pa.RecordBatch, level: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    rows: dict[int, list[int]] = {}
    for i, h in enumerate(batch.column("h").to_pylist()):
        rows.setdefault((h >> (FANOUT_BITS * level)) & ((1 << FANOUT_BITS) - 1), []).append(i)
    for p, own in rows.items():
        yield p, batch.take(pa.array(own, pa.int32()))


def _grace(batches: Iterator[pa.RecordBatch], text: str | None, most: int, level: int = 0) -> Iterator[_Bucket]:
    """Buckets that fit, each complete."""
    bucket, files, schema = _Bucket(text), None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            schema = part.schema
            if files is None:
                bucket.add(part)
                if bucket.bytes <= most or level >= DEEPEST:
                    continue
                files = {}
                spill = bucket.rows(schema)
                bucket = None
            else:
                spill = [part]
            for rows in spill:
                for p, own in _parts(rows, level):
                    if p not in files:
                        files[p] = (f := tempfile.TemporaryFile(), pa.ipc.new_stream(f, schema))
                    files[p][1].write_batch(own)
    if files is None:
        yield bucket
        return
    for _, writer in files.values():
        writer.close()
    for f, _ in files.values():
        f.seek(0)
        yield from _grace(pa.ipc.open_stream(f), text, most, level + 1)
        f.close()


def _resolve(batches: Iterator[pa.RecordBatch], schema: pa.Schema, text: str | None, most: int) -> Iterator[pa.RecordBatch]:
    for bucket in _grace(batches, text, most):
        if text:
            for at in range(0, len(bucket.payload), 1024):
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(bucket.payload[at : at + 1024])], schema=schema)
            continue
        digest = [hashlib.sha256(c).hexdigest() for c in bucket.table.contents]
        own = bucket.of
        keep = [bucket.best[e] for e in own]
        columns = [bucket.rep, [bucket.rep[b] for b in keep], [None if bucket.ids[b] == NO_ID else bucket.ids[b] for b in keep], [bucket.size[e] for e in own], [digest[e] for e in own]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _folded(docs: DataFrame, text_col: str, id_col: str, rows: bool) -> DataFrame:
    payload = whole_row(docs) if rows else F.col(quoted(text_col))
    kind = row_type(docs) if rows else T.StringType()
    out = T.StructType().add("h", "long").add("uid", "long").add("rep", "long").add("n", "long").add("doc_id", "long").add("payload", kind)
    slim = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(quoted(id_col)).cast("long").alias("doc_id"), payload.alias("payload"))
    arrow, text = to_arrow_schema(out), text_col if rows else None
    return slim.mapInArrow(lambda it: _fold(it, arrow, text), out)


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    folded = materialise(_folded(docs, text_col, id_col, rows=False), "dedup")
    out = T.StructType().add("rep", "long").add("keep_uid", "long").add("keep_id", "long").add("group_size", "long").add("text_sha256", "string")
    arrow = to_arrow_schema(out)
    reps = folded.where("n > 0").select("h", "rep", "n", "doc_id", "payload").repartition("h").mapInArrow(lambda it: _resolve(it, arrow, None, bucket_bytes), out)
    return folded.select("uid", "doc_id", "rep").join(reps, "rep").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows that stay, with all their columns; texts cross the exchange once."""
    out = T.StructType().add("payload", row_type(docs))
    arrow = to_arrow_schema(out)
    reps = _folded(docs, text_col, id_col, rows=True).where("n > 0").select("h", "rep", "n", "doc_id", "payload").repartition("h")
    kept = reps.mapInArrow(lambda it: _resolve(it, arrow, text_col, bucket_bytes), out)
    return kept.select(*[F.col("payload").getField(c).alias(c) for c in docs.columns])
