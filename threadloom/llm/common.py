"""What the operators of this subpackage share: work tables, Arrow access, per-process caches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.worktables import materialise, work_folder

__all__ = ["CHUNK_BYTES", "chunks", "crc_remainder", "free_name", "joined", "materialise", "per_process", "quoted", "row_type", "texts_of", "to_arrow_schema", "whole_row", "work_folder"]

#: Arrow batches are gathered up to this many bytes before vectorised work on them begins.
CHUNK_BYTES = 4 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """The row as one struct: column names of the input can't clash with an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, in any case: the given one, else with underscores behind it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_type(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Regroup batches into ones of about `most` bytes (a single larger row stays whole)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, batch.num_rows * most // max(1, 2 * batch.nbytes))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= most:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)
        held.clear()
    give_back()


def give_back() -> None:
    """Hand memory that a Python worker no longer uses back to the machine: workers outlive tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call
        pass


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    table = pa.Table.from_batches(held).combine_chunks()
    return table.to_batches()[0]


def per_process(key: str, make: Callable):
    """A value kept for the life of a Python worker, which outlives tasks."""
    kept = sys.__dict__.setdefault("_threadloom_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; a null value gives -1, which is in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def to_arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema as convert

    return convert(schema)
