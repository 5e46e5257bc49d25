"""Words of whole texts by array operations, for a search that asks for a few of them: the same words as `text.tokens` finds.

What becomes of every character is read from the engine once a session, so both ways split alike. The few characters whose lower
case depends on their neighbours are named in `Folds.odd`; texts with one of them have to be split by the engine.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import folded

SEPARATES, DROPPED, ODD = 0, -1, -2
CONTEXTUAL = "Σ"  # at a word's end it becomes another letter
POINTS, LINE = 0x110000, 10
PLANES = [*range(0x40000), *range(0xE0000, 0xF0000)]  # the other planes have no characters or private ones only, which separate

_known: dict[str, "Folds"] = {}


@dataclass(frozen=True)
class Folds:
    packed: bytes  # for every code point the letter or digit that it becomes, SEPARATES, DROPPED or ODD
    odd: str


def folds(spark: SparkSession) -> Folds:
    """What the engine makes of each code point alone: one a line, so that none is next to another."""
    app = spark.sparkContext.applicationId
    if app not in _known:
        points = np.array([c for c in PLANES if not 0xD800 <= c < 0xE000 and c != LINE], "<u4")
        blocks = np.array_split(points, 64)
        lines = [np.stack([b, np.full(len(b), LINE, "<u4")], 1).tobytes().decode("utf-32-le") for b in blocks]
        low = spark.createDataFrame(pa.table({"n": list(range(len(lines))), "t": lines})).select("n", folded("t").alias("t"))
        rows = low.select("n", "t", F.regexp_replace("t", r"[^\p{L}\p{N}\n]", "")).collect()
        table = np.zeros(POINTS, "<i4")
        for n, *texts in rows:
            (all_of, first), (kept, letter) = (_lines(t) for t in texts)
            if len(all_of) != len(blocks[n]) or len(kept) != len(blocks[n]):
                raise RuntimeError("a character became a line end")
            table[blocks[n]] = np.select([all_of == 0, kept == 0, (all_of == 1) & (kept == 1)], [DROPPED, SEPARATES, letter], ODD)
        table[ord(CONTEXTUAL)] = ODD
        _known[app] = Folds(zlib.compress(table.tobytes(), 1), "".join(map(chr, np.flatnonzero(table == ODD))))
    return _known[app]


def _lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The length of each line and its first code point (of an empty one: the line end)."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    ends = np.flatnonzero(points == LINE)
    begins = np.concatenate([[0], ends[:-1] + 1])
    return ends - begins, points[begins]


@lru_cache(2)
def _table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<i4")


def _codes(texts: pa.StringArray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' folded code points without the dropped ones, and where each text begins (and the last ends)."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    own = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds.astype(np.int64) - bounds[0]
    if not len(own) or own.max() < 0x80:
        return table[own], bounds
    bounds = np.append(0, np.cumsum((own & 0xC0) != 0x80))[bounds]
    codes = table[np.frombuffer(own.tobytes().decode().encode("utf-32-le"), "<u4")]
    kept = codes != DROPPED
    return (codes, bounds) if kept.all() else (codes[kept], np.append(0, np.cumsum(kept))[bounds])


def _strings(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    """The words that begin at `first` with `sizes` code points."""
    ends = np.cumsum(sizes)
    points = codes[np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)]
    if points.max() < 0x80:
        data = points.astype(np.uint8).tobytes()
    else:
        data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
        ends = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))[ends - 1]
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data))


def places_of(texts: pa.StringArray, asked: list[str], packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many words each text (no null, no odd character) has, and row, place and number in `asked` of each word asked for, in order."""
    table, none = _table(packed), np.empty(0, np.int64)
    codes, bounds = _codes(texts, table)
    word = codes > 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begins, ends = bounds[:-1][bounds[:-1] < len(word)], bounds[1:][bounds[1:] > 0] - 1
    first[begins], last[ends] = word[begins], word[ends]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    before = np.searchsorted(first, bounds)
    wanted = [a for a in asked if a]
    if not len(first) or not wanted:
        return np.diff(before), none, none, none
    sizes, most = last - first + 1, max(map(len, wanted))
    by_size, by_begin = np.zeros(most + 2, bool), np.zeros(POINTS, bool)
    by_size[[len(a) for a in wanted]] = by_begin[[ord(a[0]) for a in wanted]] = True
    likely = np.flatnonzero(by_size[np.minimum(sizes, most + 1)] & by_begin[codes[first]])
    if not len(likely):
        return np.diff(before), none, none, none
    number = pc.fill_null(pc.index_in(_strings(codes, first[likely], sizes[likely]), value_set=pa.array(asked, pa.string())), -1).to_numpy()
    met = number >= 0
    at = likely[met]
    rows = np.searchsorted(bounds, first[at], side="right") - 1
    return np.diff(before), rows, at - before[rows], number[met].astype(np.int64)
