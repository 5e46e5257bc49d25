"""Python functions of single rows, applied to slices of bounded size, so that a worker's memory doesn't grow with a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE = 2_000_000  # bytes of texts in a slice (or a single row), about


def slices(*columns: pa.Array) -> Iterator[tuple[list, ...]]:
    """The columns' values, in slices of about SLICE bytes."""
    sizes = np.full(len(columns[0]), 16, dtype=np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SLICE)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        yield tuple(c.slice(low, high - low).to_pylist() for c in columns)


def _native(value, kind: T.DataType):
    """A value as Arrow takes it: maps as pairs."""
    if value is None:
        return None
    if isinstance(kind, T.MapType):
        return list(value.items())
    if isinstance(kind, T.StructType):
        return {f.name: _native(value[f.name], f.dataType) for f in kind.fields}
    return value


def per_row(f: Callable, kind: T.DataType):
    """A column function of one column."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for (values,) in slices(column):
                yield pa.array([_native(f(x), kind) for x in values], arrow)

    return apply


def per_row_of_two(f: Callable, kind: T.DataType):
    """A column function of two columns."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            for a, b in slices(one, two):
                yield pa.array([_native(f(x, y), kind) for x, y in zip(a, b, strict=True)], arrow)

    return apply
