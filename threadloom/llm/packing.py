"""Packing by a configuration linear program over the length histogram.

The program has a row for each length (1 to 2047, however many documents there are) and a column for each content of a
sequence, so it is solved on the driver. Multiplicative weights price the lengths: every share of a length that is covered
lowers its price by a constant factor, and a knapsack dynamic program over a working set of the lengths that lag most finds,
for each open length, the best content that holds it. What the columns cover sums to the fractional solution.
It is then rounded: columns of large multiplicity are rounded down, those below one up as far as pieces are left, and the
program is solved again for the rest until columns find nothing more. The few pieces that no column takes go by best fit.
Pieces are placed by their rank among the pieces of their length: a range of ranks goes to the same slot of a
range of sequences, so nothing but the plan is sent out.

Defined cases: null and empty texts are the single id 0; a longer document, however long, is cut into 2048-token pieces;
repeated rows are packed each; ties in price fall as the seeded order of the lengths has it; an empty table gives an empty
result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialise, quoted, texts_of, to_arrow_schema
from .encoder import default_path, encoder

CAPACITY = 2048
END = b"\0\0\0\0"
ROUNDS = 90  # of pricing at most, each time that the program is solved
WORKING = 192  # lengths that a round's knapsack draws on, those that lag most; every open length gets a column all the same
STEP = 0.6  # share of what a column could still cover that a round gives it
RATE = 0.5  # a length whose whole need is covered has its price lowered by exp(-RATE)
LONG = 0.5  # a piece as long as a sequence is priced this share higher a token, for short pieces fill gaps later
SOLVED = 0.01  # share of the tokens that may stay uncovered when the rounds end
WASTE = (0.0, 0.0, 0.0, 1 / 256, 1 / 32, 1.0)  # share of a sequence that a column may leave free, as solving goes on
Plan = list[tuple[dict[int, int], int]]


class Columns(NamedTuple):
    """A fractional solution: column k holds times[k] pieces of lengths[k] and is used x[k] times."""

    x: np.ndarray
    lengths: list[np.ndarray]
    times: list[np.ndarray]
    uncovered: np.ndarray  # pieces of each length that no column covers


class Solution(NamedTuple):
    program: Plan  # contents from the program's columns
    rest: Plan  # contents from best fit
    objective: float  # of the first fractional solution, uncovered lengths filled up by columns of one length


def _items(counts: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Knapsack items: for each length, multiples that can make up any number of pieces that there are."""
    own, times = [], []
    for size in lengths.tolist():
        n, k = min(int(counts[size]), capacity // size), 1
        while n:
            k = min(k, n)
            own.append(size)
            times.append(k)
            n, k = n - k, 2 * k
    return np.array(own, np.int64), np.array(times, np.int64), np.array(own, np.int64) * np.array(times, np.int64)


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of items (each at most once) for each room, and by [item, room] whether the item was taken."""
    best, taken = np.zeros(capacity + 1), np.zeros((len(sizes), capacity + 1), bool)
    for k, (size, value) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
        with_it = best[: capacity + 1 - size] + value
        np.greater(with_it, best[size:], out=taken[k, size:])
        np.maximum(with_it, best[size:], out=best[size:])
    return best, taken


def _contents(counts: np.ndarray, first: np.ndarray, working: np.ndarray, price: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each length of `first` the best content that holds it: (free room), (column, length, times) sorted by column."""
    own, times, sizes = _items(counts, working, capacity)
    order = rng.permutation(len(sizes))
    own, times, sizes = own[order], times[order], sizes[order]
    _, taken = knapsack(sizes, price[own] * times, capacity)
    rooms, column, length, n = capacity - first, [np.arange(len(first))], [first], [np.ones(len(first), np.int64)]
    for k in range(len(sizes) - 1, -1, -1):
        hit = np.flatnonzero(taken[k, rooms])
        if len(hit):
            rooms[hit] -= sizes[k]
            column.append(hit)
            length.append(np.full(len(hit), own[k]))
            n.append(np.full(len(hit), times[k]))
    names, at = np.unique(np.concatenate(column) * (capacity + 1) + np.concatenate(length), return_inverse=True)
    return rooms, names // (capacity + 1), names % (capacity + 1), np.bincount(at, np.concatenate(n)).astype(np.int64)


def fractional(counts: np.ndarray, capacity: int, waste: float = 0.0, rounds: int = ROUNDS, seed: int = 0) -> Columns:
    """Multiplicative weights for the program; no length is covered beyond its need."""
    rng, need, sizes = np.random.default_rng(seed), counts.astype(np.float64), np.arange(capacity + 1)
    left, x, held, multiples = need.copy(), [], [], []
    lengths = np.flatnonzero(counts)
    for _ in range(rounds):
        first = lengths[left[lengths] > 1e-6 * need[lengths]]
        if not len(first) or left @ sizes <= SOLVED * (need @ sizes):
            break
        share = left[first] / need[first]
        price = np.zeros(capacity + 1)
        price[first] = first * (1 + LONG * first / capacity) * np.exp(RATE * (share - 1))
        working = first[np.argsort(-share - 0.5 * rng.random(len(first)))[:WORKING]]
        rooms, column, length, times = _contents(counts, first, working, price, capacity, rng)
        bounds, fits = np.searchsorted(column, np.arange(len(first) + 1)).tolist(), (rooms <= waste * capacity).tolist()
        for k in range(len(first) - 1, -1, -1):  # the longest first
            own, n = length[bounds[k] : bounds[k + 1]], times[bounds[k] : bounds[k + 1]]
            most = float((left[own] / n).min()) if fits[k] and (n <= counts[own]).all() else 0.0
            if most > 1e-6:
                step = STEP * most if most > 0.02 * float((need[own] / n).min()) else most
                left[own] -= step * n
                x.append(step)
                held.append(own)
                multiples.append(n)
    return Columns(np.array(x), held, multiples, np.maximum(left, 0))


def rounded(columns: Columns, left: np.ndarray) -> Plan:
    """Whole multiplicities, largest columns first; `left` loses the pieces that they hold."""
    plan = []
    for k in np.argsort(-columns.x, kind="stable").tolist():
        own, n = columns.lengths[k], columns.times[k]
        times = min(max(int(columns.x[k]), 1), int((left[own] // n).min()))
        if times > 0:
            left[own] -= times * n
            plan.append((dict(zip(own.tolist(), n.tolist(), strict=True)), times))
    return plan


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: sequences with the same content move together, so steps don't grow with counts."""
    rooms: list[int] = []  # free rooms, ascending
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: dict[tuple[int, ...], int] = {}

    def put(room: int, content: tuple[int, ...], times: int) -> None:
        if room == 0:
            done[content] = done.get(content, 0) + times
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((content, times))

    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if n >= each:
                    put(capacity - each * size, (size,) * each, n // each)
                if n % each:
                    put(capacity - n % each * size, (size,) * (n % each), 1)
                break
            room = rooms[at]
            content, times = groups[room].pop()
            each = min(room // size, -(-n // times))
            if n < each * times:  # the last sequences get fewer
                whole = n // each
                if times > whole:
                    groups[room].append((content, times - whole))
                times = whole
                if not whole:
                    groups[room][-1] = (content, groups[room][-1][1] - 1)
                    if not groups[room][-1][1]:
                        groups[room].pop()
                    each, times = n, 1
            if not groups[room]:
                del groups[room], rooms[at]
            put(room - each * size, content + (size,) * each, times)
            n -= each * times
    for own in groups.values():
        for content, times in own:
            done[content] = done.get(content, 0) + times
    return [({s: content.count(s) for s in set(content)}, times) for content, times in done.items()]


def solve_parts(counts: np.ndarray, capacity: int = CAPACITY) -> Solution:
    """Rounded solutions of the program, solved again for what is left, then best fit.

    Should that take more sequences than best fit alone, the columns found last are given up, twice as many each time.
    """
    left, program, objective, sizes = counts.astype(np.int64).copy(), [], 0.0, np.arange(capacity + 1)
    for step, waste in enumerate(WASTE):
        while left.any():
            columns = fractional(left, capacity, waste, seed=step)
            if not program:
                alone = columns.uncovered[1:] / (capacity // np.maximum(sizes[1:], 1))
                objective = float(columns.x.sum() + alone.sum())
            before = left @ sizes
            program += rounded(columns, left)
            if left @ sizes > 0.8 * before:
                break
    rest, given_up = best_fit(left, capacity), 1
    most = sum(n for _, n in best_fit(counts.astype(np.int64), capacity))
    while program and sum(n for _, n in program) + sum(n for _, n in rest) > most:
        for content, n in program[-given_up:]:
            for size, k in content.items():
                left[size] += k * n
        program, given_up = program[:-given_up], 2 * given_up
        rest = best_fit(left, capacity)
    return Solution(program, rest, objective)


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Contents (length -> how often) with whole multiplicities that use exactly counts[length] pieces of each length."""
    found = solve_parts(counts, capacity)
    return found.program + found.rest


class Placement:
    """Where the piece of a given length and rank goes."""

    def __init__(self, plan: Plan, first_sequence: int):
        ranges: dict[int, list[tuple[int, int, int]]] = {}
        ranks: dict[int, int] = {}
        at = first_sequence
        for content, times in plan:
            offset = 0
            for size, n in sorted(content.items(), reverse=True):
                for _ in range(n):
                    rank = ranks.get(size, 0)
                    ranges.setdefault(size, []).append((rank, at, offset))
                    ranks[size] = rank + times
                    offset += size
            at += times
        self.sequences = at
        self.ranges = {s: np.array(r, np.int64).T.copy() for s, r in ranges.items()}

    def of(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, sequence, offset = self.ranges[size]
        at = np.searchsorted(first, rank, side="right") - 1
        return sequence[at] + rank - first[at], offset[at]


PIECE = T.StructType().add("doc_id", "long").add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("part", "integer").add("place", "long")
PACKED = T.StructType().add("doc_id", "long").add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("sequence_id", "long").add("offset", "long")


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema, path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, ids, seen = TaskContext.get().partitionId(), encoder(path).ids, {}
    for batch in chunks(batches):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
            own = ids(text) + END
            for k, at in enumerate(range(0, len(own), 4 * capacity)):
                cut = own[at : at + 4 * capacity]
                size = len(cut) // 4
                place = seen.get(size, 0)
                seen[size] = place + 1
                rows.append((doc, k, at // 4, size, crc32(cut), part, place))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _place(batches: Iterator[pa.RecordBatch], schema: pa.Schema, placement: Placement, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = rank.copy(), np.zeros_like(rank)  # a full piece is a sequence of its own
        for size in np.unique(length[length < capacity]).tolist():
            own = length == size
            sequence[own], offset[own] = placement.of(size, rank[own])
        yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in list(schema)[:5]), pa.array(sequence), pa.array(offset)], schema=schema)


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    schema, path = to_arrow_schema(PIECE), tokenizer or default_path()
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    pieces = materialise(slim.mapInArrow(lambda it: _pieces(it, schema, path, capacity), PIECE), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length, at most `capacity`
        counts[r["length"]] = r["n"]
    full, counts[capacity] = int(counts[capacity]), 0
    placement = Placement(solve(counts, capacity), full)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    given, out = docs.sparkSession.sparkContext.broadcast(placement), to_arrow_schema(PACKED)
    return ranked.mapInArrow(lambda it: _place(it, out, given.value, capacity), PACKED)
