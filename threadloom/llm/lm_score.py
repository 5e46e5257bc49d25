"""Language-model scores by online logistic context mixing, over words and, for new words, over their bytes.

A text is the sequence of its tokens and one end. Each token is coded by binary decisions, from the longest context down:
has it been met after the two tokens before it; after the one before it; at all. A decision that says yes is followed by the
token's share among what was met there; a token that was never met is spelt bit by bit. Every bit, decision or spelt, is
predicted by several predictors, each of which looks counts up under another hashed context (WAYS contexts of counts,
history and runs for decisions; the last 1, 2, 3 and 5 bytes for spelt bits). Their log-odds are mixed with weights that a gate
chooses; the weights are learnt by online gradient steps through each segment of training text (about a million words) and
averaged over segments, and the mixture is refined by an adaptive map from (gate, log-odds) to observed frequency. While a text is coded, its weights go on learning from what was coded of it before (at bits 32, 64, 128
and so on) and begin anew with the next text, so a score doesn't depend on how rows are dealt out.

What is gathered from the corpus grows with it and stays distributed: counts of tokens and of two and three tokens in a row.
Segments of text send their distinct n-grams, as sorted hashes in compressed blocks, to buckets (as many as the input needs);
buckets sum them and send the counts back. Hashes are wide enough that an n-gram takes another's count in less than one case of
1,000, whatever the input's size. Only the model of mixing and spelling, of a fixed number of slots, meets on the driver,
summed in a tree. A training text's own occurrences are taken off all counts that predict it, so training and held-out texts
are scored alike.

Defined cases: null and empty texts are the end alone; a document with null doc_id trains and isn't held out; repeated rows
count each; very long texts make a segment of their own and are scored whole; without any training document nothing is known and
every bit has chance 1/2; ties don't occur, for nothing is ranked; an empty table gives an empty result; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, crc_remainder, materialise, quoted, texts_of, to_arrow_schema
from .words import tokens

SEGMENT_BYTES = 8 << 20
GROUP_TOKENS = 1 << 18  # of a segment's texts whose decisions are held at once
BUCKET_ENTRIES = 1 << 20  # n-grams or tokens of segments that a bucket has about
SPARE_BITS = 10  # of an n-gram's hash beyond the number of n-grams
MOST_PARTITIONS = 100_000  # of an exchange by segment or bucket
DELTA = 0.4  # added to both counts of a slot
BUCKETS = 33  # of log-odds from -8 to 8
STEP = 0.02
_F1, _F2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = b" \t\n\v\f\r"
_BEGIN = np.uint64(0x632BE59BD9B4E019)
_F32 = np.uint32(0x9E3779B1)
_SALTS = np.arange(1, 8, dtype=np.uint32) * np.uint32(0x85EBCA77)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _bucket(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((x + 8) * 2), 0, BUCKETS - 1).astype(np.int64)


def _centres() -> np.ndarray:
    return _squash((np.arange(BUCKETS) / 2 - 8)[None, :])


def _compressed(raw: bytes, level: int = 3) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def packed(values: np.ndarray, level: int = 3) -> bytes:
    """Whole numbers >= 0 in as few bytes each as the largest needs, byte by byte of all, compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    raw = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + _compressed(raw, level)


def unpacked(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    raw = np.frombuffer(pa.decompress(data[9:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64 if width < 8 else np.uint64)


def packed_words(words: list[bytes]) -> bytes:
    raw = b"\n".join(words)  # a token holds no line break
    return len(raw).to_bytes(8, "little") + _compressed(raw)


def unpacked_words(data: bytes, n: int) -> list[bytes]:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return raw.split(b"\n") if n else []


# ---- spelling of new words ---------------------------------------------------------------------------------------

ORDERS = (1, 2, 3, 5)
K = len(ORDERS)
SLOT_BITS = 20
BLOCK = 1 << 16  # slots that are summed as one row
#: How often a slot was met: never, less than 3 times, less than 30 times, more often.
LEVELS = (1, 3, 30)
SPELL_GATES = (K + 1) * (len(LEVELS) + 1) * 8


class Bits:
    """The bits of some tokens, each closed by a terminator, with the slots of their contexts."""

    def __init__(self, words: list[bytes]):
        flat = np.frombuffer(b"".join([w + b"\n" for w in words]), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(words)), sizes)
        self.byte = flat.astype(np.uint64)
        first = np.zeros(len(flat), bool)
        first[self.starts] = True
        before, self.contexts = np.ones(len(flat), np.uint64), []
        code = np.concatenate([[np.uint64(0)], self.byte[:-1] + np.uint64(1)]) if len(flat) else self.byte
        for n in range(1, max(ORDERS) + 1):
            own = np.concatenate([before[:1], before[:-1]]) * _F1 + code
            own[first] = np.uint64(7)  # the begin of a token stands for all that lies before it
            if n in ORDERS:
                self.contexts.append((own + np.uint64(n)) * _F1)
            before = own

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each of the eight bits: its place, partial bytes, the bits, and slots in each predictor."""
        partial = np.ones(len(self.byte), np.uint64)
        for place in range(8):
            bit = (self.byte >> np.uint64(7 - place)) & np.uint64(1)
            slots = [((c ^ (partial << np.uint64(32))) * _F1 >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for c in self.contexts]
            yield place, partial.astype(np.int64), bit.astype(np.int64), slots
            partial = (partial << np.uint64(1)) | bit


def count_slots(words: list[bytes], counts: np.ndarray) -> None:
    """Adds the tokens' bits to counts[predictor, 2 * slot + bit]."""
    steps = [(bit, slots) for _, _, bit, slots in Bits(words).steps()]
    for k in range(K):
        counts[k] += np.bincount(np.concatenate([2 * slots[k] + bit for bit, slots in steps]), minlength=2 << SLOT_BITS)


def spell_weights() -> np.ndarray:
    """Before learning, the longest context met is trusted most."""
    out = np.zeros((K + 1, len(LEVELS) + 1, 8, K))
    for k in range(K):
        out[k + 1, :, :, k], out[k + 1, :, :, max(0, k - 1)] = 0.8, 0.2 if k else 0.8
    return out.reshape(SPELL_GATES, K)


def spell_tables(counts: np.ndarray) -> np.ndarray:
    """Log-odds in thousandths, times four, and levels, as one number by [predictor, way, slot].

    The ways are all counts, and those without one 0 or without one 1.
    """
    out = np.zeros((K, 3, 1 << SLOT_BITS), np.int16)
    for k in range(K):
        zeros, ones = counts[k, ::2].astype(np.float32), counts[k, 1::2].astype(np.float32)
        less = np.maximum(zeros - 1, 0), np.maximum(ones - 1, 0)
        log = [np.log(x + np.float32(DELTA)) for x in (zeros, ones, *less)]
        for way, (z, o, total) in enumerate(((0, 1, zeros + ones), (2, 1, less[0] + ones), (0, 3, zeros + less[1]))):
            odds = np.rint(1000 * np.clip(log[o] - log[z], -8, 8)).astype(np.int16)
            out[k, way] = odds * np.int16(4) + sum((total >= x).astype(np.int16) for x in LEVELS)
    return out


def _spell_mix(tables: np.ndarray, way: np.ndarray, slots: list[np.ndarray], place: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Gates, mixed log-odds and each predictor's log-odds."""
    found = [tables[k][way, slot] for k, slot in enumerate(slots)]
    odds = [(x >> 2) * np.float32(0.001) for x in found]
    seen = np.zeros(len(way), np.int64)
    for k, x in enumerate(found):
        level = x & 3
        seen = np.where(level > 0, (k + 1) * (len(LEVELS) + 1) + level, seen)
    gate = seen * 8 + place  # the longest context met, how often it was met, and the bit's place
    return gate, sum(weights[gate, k] * o for k, o in enumerate(odds)), odds


class Spelling:
    """Counts of all slots with their log-odds and levels; only the counts, compressed, go from place to place."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, refined: np.ndarray):
        self.counts = [packed(x.astype(np.int64)) for x in counts]
        self.weights, self.refined = weights, refined  # the chance of a 1 by partial byte and bucket

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    @cached_property
    def tables(self) -> np.ndarray:
        return spell_tables(np.stack([unpacked(x) for x in self.counts]))

    def log10(self, words: list[bytes], known: np.ndarray) -> np.ndarray:
        """log10 of each token's chance; the one occurrence of a known token doesn't help to predict it."""
        out = np.zeros(len(words))
        if not words:
            return out
        bits = Bits(words)
        cost, own = np.zeros(len(bits.byte)), known[bits.owner]
        for place, partial, bit, slots in bits.steps():
            _, mixed, _ = _spell_mix(self.tables, np.where(own, 1 + bit, 0), slots, place, self.weights)
            p = np.clip((_squash(mixed) + self.refined[partial, _bucket(mixed)]) / 2, 1e-6, 1 - 1e-6)
            cost += np.log10(np.where(bit == 1, p, 1 - p))
        return np.add.reduceat(cost, bits.starts)


def learn_spelling(words: list[bytes], tables: np.ndarray, weights: np.ndarray, squares: np.ndarray, seen: np.ndarray, met: np.ndarray, hits: np.ndarray, batch: int = 2000) -> None:
    """Online pass over known tokens, each predicted without its own occurrence: moves all the given arrays on."""
    for at in range(0, len(words), batch):
        for place, partial, bit, slots in Bits(words[at : at + batch]).steps():
            gate, mixed, odds = _spell_mix(tables, 1 + bit, slots, place, weights)
            error, total = bit - _squash(mixed), np.bincount(gate, minlength=len(weights))
            seen += total
            cell = partial * BUCKETS + _bucket(mixed)
            met += np.bincount(cell, minlength=met.size).reshape(met.shape)
            hits += np.bincount(cell, bit, met.size).reshape(met.shape)
            for k, o in enumerate(odds):
                slope = np.bincount(gate, error * o, len(weights)) / np.maximum(total, 1)
                squares[:, k] += slope**2
                weights[:, k] += STEP * slope / np.sqrt(squares[:, k])


# ---- decisions about words ---------------------------------------------------------------------------------------

WAYS = 6  # predictors of a decision
WAY_BITS = 14
GATES = 3 * 4 * 4
MIX_STEP = 0.08
ADAPT = 0.3  # step of a text's own weights
FIRST_STOP = 32  # decisions of a text after which its weights are first moved on


class Decisions:
    """The decisions of some texts in order: text, bit, gate, slots of each predictor; and the chance of what isn't decided.

    c1, c2, c3: training counts of the 1, 2 and 3 tokens that end at each place; lengths: tokens of each text with its end;
    trains: whether a text is one of the training texts; spelt: log10 chance of a new word's spelling.
    """

    def __init__(self, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, spelt: np.ndarray, lengths: np.ndarray, trains: np.ndarray, n_train: int, n_docs: int):
        starts, text = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
        own = trains[text].astype(np.int64)
        before = lambda x, start: _shifted(x, starts, start)
        n1, n2 = np.maximum(before(c1, n_docs) - own, 0), np.maximum(before(c2, n_docs) - own, 0)
        k1, k2, k3 = (np.maximum(c - own, 0) for c in (c1, c2, c3))
        k2, k3 = np.minimum(k2, n1), np.minimum(k3, n2)  # a hash may take another n-gram's count
        level = (np.int8(3) - (k1 > 0)) * (k2 == 0) * (k3 == 0) + ((k2 > 0) & (k3 == 0))
        over, under = np.where(level == 0, k3, np.where(level == 1, k2, k1)), np.where(level == 0, n2, np.where(level == 1, n1, n_train - own))
        new = level == 3
        self.rest = np.log10(np.where(new, 1, over) / np.where(new, 1, under))
        self.rest[new] = spelt[new]
        h1 = before(level, 3)
        h2 = before(h1, 3)
        h3 = before(h2, 3)
        place = np.arange(len(level), dtype=np.int32)
        last = np.maximum.accumulate(np.where(level > 0, place, np.int32(-1))) if len(level) else place  # of places up to here
        run = place - 1 - np.maximum(before(last, -1), (starts - 1).astype(np.int32)[text])
        asked = np.stack([n2 > 0, (level > 0) & (n1 > 0), level > 1], axis=1)
        at = np.flatnonzero(asked.ravel())
        at, kind = np.divmod(at.astype(np.uint32 if len(level) < 1 << 30 else np.uint64), 3)
        kind = kind.astype(np.uint32)
        self.text, self.bit = text[at], (level[at] == kind).astype(np.int64)
        past = (h1.astype(np.uint32), h2.astype(np.uint32), h3.astype(np.uint32))
        q1, q2 = _size(n1), _size(n2)
        q, history, pair = np.where(kind == 0, q2[at], q1[at]), past[0] * 16 + past[1] * 4 + past[2], past[0] * 4 + past[1]
        self.gate = ((kind * 4 + past[0][at]) * 4 + np.minimum(q, 3)).astype(np.int64)
        contexts = (q, history[at], q * 16 + pair[at], n1.astype(np.uint32)[at], ((q2 * 64 + q1) * 4 + past[0])[at], _size(run)[at] * 64 + q)
        self.slots = [((c * np.uint32(3) + kind) * _F32 + _SALTS[way] >> np.uint32(32 - WAY_BITS)).astype(np.int64) for way, c in enumerate(contexts)]
        self.texts, self.starts = len(lengths), starts


def _shifted(x: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
    """What stands one place before, within each text; `start` before its first place."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = start
    return out


def _size(n: np.ndarray) -> np.ndarray:
    """Number of binary digits."""
    return np.frexp(n.astype(np.float64))[1].astype(np.uint32)


class Learner:
    """State of an online pass over decisions: counts of slots, weights, and what the refining map met."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.squares, self.counts = weights.copy(), np.full((GATES, WAYS), 1e-6), np.zeros((WAYS, 2 << WAY_BITS), np.int64)
        self.seen, self.met, self.hits = np.zeros(GATES), np.zeros((GATES, BUCKETS)), np.zeros((GATES, BUCKETS))
        self.block = 1 << 11

    def learn(self, own: Decisions) -> None:
        """Predicts block after block with what was counted before, then counts it and moves the weights on. Blocks grow to 2^16 decisions."""
        at = 0
        while at < len(own.bit):
            block = self.block
            bit, gate, slots = own.bit[at : at + block], own.gate[at : at + block], [s[at : at + block] for s in own.slots]
            at, self.block = at + block, min(2 * block, 1 << 16)
            tables = np.log((self.counts[:, 1::2] + DELTA) / (self.counts[:, ::2] + DELTA)) if block > 1 << WAY_BITS else None
            odds = [np.log((self.counts[k][2 * s + 1] + DELTA) / (self.counts[k][2 * s] + DELTA)) if tables is None else tables[k][s] for k, s in enumerate(slots)]
            mixed = sum(self.weights[gate, k] * o for k, o in enumerate(odds))
            error, total = bit - _squash(mixed), np.bincount(gate, minlength=GATES)
            self.seen += total
            cell = gate * BUCKETS + _bucket(mixed)
            self.met += np.bincount(cell, minlength=GATES * BUCKETS).reshape(GATES, BUCKETS)
            self.hits += np.bincount(cell, bit, GATES * BUCKETS).reshape(GATES, BUCKETS)
            for k, o in enumerate(odds):
                slope = np.bincount(gate, error * o, GATES) / np.maximum(total, 1)
                self.squares[:, k] += slope**2
                self.weights[:, k] += MIX_STEP * slope / np.sqrt(self.squares[:, k])
                self.counts[k] += np.bincount(2 * slots[k] + bit, minlength=2 << WAY_BITS)


@dataclass
class Mixing:
    odds: np.ndarray  # by predictor and slot
    weights: np.ndarray  # by gate
    refined: np.ndarray  # chance of yes by gate and bucket

    def log10(self, own: Decisions) -> np.ndarray:
        """log10 chance of each text. A text's weights move on at its 32nd, 64th, 128th decision and so on."""
        out = np.add.reduceat(own.rest, own.starts) if own.texts else np.zeros(0)
        n = len(own.bit)
        if not n:
            return out
        key = own.text * GATES + own.gate
        there = np.bincount(key) > 0
        names, pair = np.flatnonzero(there), (np.cumsum(there) - 1)[key]
        weights = np.ascontiguousarray(self.weights[names % GATES].T)  # by predictor
        nth = np.arange(n) - np.searchsorted(own.text, np.arange(own.texts))[own.text]
        stop = _size(nth // FIRST_STOP).astype(np.uint8)
        order = np.argsort(stop, kind="stable")
        ends = np.cumsum([0, *np.bincount(stop)])
        cost = np.zeros(n)
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            at = order[a:z]
            bit, to = own.bit[at], pair[at]
            odds = [self.odds[k][s[at]] for k, s in enumerate(own.slots)]
            mixed = sum(w[to] * o for w, o in zip(weights, odds, strict=True))
            p = np.clip((_squash(mixed) + self.refined[own.gate[at], _bucket(mixed)]) / 2, 1e-6, 1 - 1e-6)
            cost[at] = np.log10(np.where(bit == 1, p, 1 - p))
            error, met = bit - _squash(mixed), np.bincount(to, minlength=len(names)) + FIRST_STOP
            for k, o in enumerate(odds):
                weights[k] += ADAPT * np.bincount(to, error * o, len(names)) / met
        return out + np.bincount(own.text, cost, own.texts)


# ---- distributed counts ------------------------------------------------------------------------------------------

SEGMENT = T.StructType().add("segment", "long").add("n_tokens", "long").add("n_distinct", "long").add("doc_ids", T.ArrayType(T.LongType())).add("held", T.ArrayType(T.BooleanType())).add("lengths", "binary").add("sizes", "binary").add("codes", "binary").add("words", "binary").add("train", "binary")
SENT = T.StructType().add("bucket", "long").add("segment", "long").add("n", "long").add("names", "binary").add("train", "binary")
VOCABULARY = T.StructType().add("bucket", "long").add("n_train", "long").add("n_types", "long").add("n", "long").add("words", "binary").add("counts", "binary").add("segments", T.ArrayType(T.LongType())).add("members", T.ArrayType(T.BinaryType()))
VALUES = T.StructType().add("segment", "long").add("kind", "integer").add("bucket", "long").add("counts", "binary").add("spelt", "binary")
COUNTED = T.StructType().add("doc_ids", T.ArrayType(T.LongType())).add("held", T.ArrayType(T.BooleanType())).add("lengths", "binary").add("sizes", "binary").add("c1", "binary").add("c2", "binary").add("c3", "binary").add("spelt", "binary").add("state", T.ArrayType(T.BinaryType()))
OUT = T.StructType().add("doc_id", "long").add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double").add("bits_per_byte", "double")


def _batch(schema: pa.Schema, *rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Texts as numbers: a row for each segment, with its distinct tokens."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for number, batch in enumerate(chunks(batches, SEGMENT_BYTES)):
        code: defaultdict[bytes, int] = defaultdict()
        code.default_factory = code.__len__
        code[b""]  # the end of a text is number 0
        lists, sizes = [], []
        for text in texts_of(batch.column("text")):
            own = tokens(text)
            own.append(b"")
            lists.append(own)
            sizes.append(len(text.translate(None, _SPACE)) + len(own))  # every token's bytes and one more
        held = batch.column("held").to_pylist()
        lengths = np.array([len(x) for x in lists], np.int64)
        codes = np.fromiter(map(code.__getitem__, chain.from_iterable(lists)), np.int64, int(lengths.sum()))
        train = np.bincount(codes[np.repeat(~np.array(held, bool), lengths)], minlength=len(code))
        yield _batch(schema, (task << 24 | number, len(codes), len(code), batch.column("doc_ids").to_pylist(), held, packed(lengths), packed(np.array(sizes)), packed(codes), packed_words(list(code)), packed(train)))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _F1 + b
    x = (x ^ (x >> np.uint64(32))) * _F2
    return x ^ (x >> np.uint64(29))


def ngrams(words: list[bytes], codes: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the two and of the three tokens that end at each place (all places of two, then all of three), of `width` bits."""
    own = _hashes(words)[codes]
    starts = np.cumsum(lengths) - lengths
    one = _shifted(own, starts, _BEGIN)
    two = _shifted(one, starts, _BEGIN)
    pair = _mixed(one, own)
    return np.concatenate([pair, _mixed(_mixed(two, one) + np.uint64(1), own)]) >> np.uint64(64 - width)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in their order, and there the number of the distinct key (0 for the least).

    Keys and places that fit into 64 bits together are sorted as one number, which is many times faster than by reference.
    """
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits <= 64:
        both = np.sort(keys << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
        order, found = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    else:
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    return order, np.cumsum(np.concatenate([[False], found[1:] != found[:-1]])) if len(keys) else order


def _send_words(batches: Iterator[pa.RecordBatch], schema: pa.Schema, buckets: int) -> Iterator[pa.RecordBatch]:
    for row in chain.from_iterable(b.to_pylist() for b in batches):
        words, train = unpacked_words(row["words"], row["n_distinct"]), unpacked(row["train"])
        to = _hashes(words) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()
        parts = [(b, order[a:z]) for b, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
        for at in range(0, len(parts), 64):
            yield _batch(schema, *((b, row["segment"], len(own), packed_words([words[i] for i in own.tolist()]), packed(train[own])) for b, own in parts[at : at + 64]))


def _gather_words(table: pa.Table) -> pa.Table:
    """The distinct tokens of a bucket with their counts, and which of them each segment holds."""
    code: defaultdict[bytes, int] = defaultdict()
    code.default_factory = code.__len__
    rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
    members = [np.fromiter(map(code.__getitem__, unpacked_words(r["names"], r["n"])), np.int64, r["n"]) for r in rows]
    counts = np.zeros(len(code), np.int64)
    for own, r in zip(members, rows, strict=True):
        counts[own] += unpacked(r["train"])
    row = (rows[0]["bucket"], int(counts.sum()), int((counts > 0).sum()), len(code), packed_words(list(code)), packed(counts), [r["segment"] for r in rows], [packed(m) for m in members])
    return pa.Table.from_batches([_batch(to_arrow_schema(VOCABULARY), row)])


def _send_ngrams(batches: Iterator[pa.RecordBatch], schema: pa.Schema, buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """A segment's distinct n-grams in order, cut into buckets: differences of neighbours, and training counts."""
    for row in chain.from_iterable(b.to_pylist() for b in batches):
        lengths = unpacked(row["lengths"])
        names = ngrams(unpacked_words(row["words"], row["n_distinct"]), unpacked(row["codes"]), lengths, width)
        trains = np.repeat(~np.array(row["held"], bool), lengths)
        names = np.sort(names << np.uint64(1) | np.concatenate([trains, trains]).astype(np.uint64))
        train, names = (names & np.uint64(1)).astype(np.int64), names >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        names, train = names[first], np.add.reduceat(train, first)
        least = _bounds(buckets, width)
        ends = np.searchsorted(names, least).tolist()
        parts = [(b, a, z) for b, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
        for at in range(0, len(parts), 64):
            yield _batch(schema, *((b, row["segment"], z - a, packed(np.diff(names[a:z], prepend=least[b]), 1), packed(train[a:z])) for b, a, z in parts[at : at + 64]))


def _bounds(buckets: int, width: int) -> np.ndarray:
    """The least hash of each bucket, and what lies beyond the last."""
    return np.array([(k << width) // buckets for k in range(buckets)] + [min(1 << width, (1 << 64) - 1)], np.uint64)


def _gather_ngrams(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    names = np.concatenate([np.cumsum(unpacked(r["names"]).astype(np.uint64), dtype=np.uint64) for r in rows])
    order, of = ranked(names)
    counts = np.empty(len(names), np.int64)
    counts[order] = np.bincount(of, np.concatenate([unpacked(r["train"]) for r in rows])[order]).astype(np.int64)[of]
    ends = np.cumsum([0, *(r["n"] for r in rows)])
    return pa.Table.from_batches([_batch(to_arrow_schema(VALUES), *((r["segment"], 1, r["bucket"], packed(counts[a:z]), None) for r, a, z in zip(rows, ends[:-1], ends[1:], strict=True)))])


def _spell(batches: Iterator[pa.RecordBatch], schema: pa.Schema, model: Spelling) -> Iterator[pa.RecordBatch]:
    """Sends counts, and the chance of the spelling where it may be asked for, back to the segments."""
    for row in chain.from_iterable(b.to_pylist() for b in batches):
        words, counts = unpacked_words(row["words"], row["n"]), unpacked(row["counts"])
        spelt, rare = np.zeros(len(words), np.float32), np.flatnonzero(counts <= 1)
        for at in range(0, len(rare), 20_000):
            own = rare[at : at + 20_000]
            spelt[own] = model.log10([words[i] for i in own.tolist()], counts[own] > 0)
        parts = list(zip(row["segments"], row["members"], strict=True))
        for at in range(0, len(parts), 64):
            members = [(s, unpacked(m)) for s, m in parts[at : at + 64]]
            yield _batch(schema, *((s, 0, row["bucket"], packed(counts[m]), packed(spelt[m].view(np.uint32))) for s, m in members))


def _counted(word_buckets: int, width: int, n_train: int, n_docs: int):
    """Puts what the buckets sent back in the places of a segment's tokens, and goes through its training texts online."""

    def place(heads: pa.Table, values: pa.Table) -> pa.Table:
        (head,) = heads.to_pylist()
        sent = sorted(values.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        words, codes, lengths = unpacked_words(head["words"], head["n_distinct"]), unpacked(head["codes"]), unpacked(head["lengths"])
        order = np.argsort(_hashes(words) % np.uint64(word_buckets), kind="stable")
        of_word, spelt = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint32)
        of_word[order] = np.concatenate([unpacked(r["counts"]) for r in sent if r["kind"] == 0])
        spelt[order] = np.concatenate([unpacked(r["spelt"]) for r in sent if r["kind"] == 0])
        order, of = ranked(ngrams(words, codes, lengths, width))
        longer = np.empty(2 * len(codes), np.int64)
        longer[order] = np.concatenate([unpacked(r["counts"]) for r in sent if r["kind"] == 1])[of]
        c1, c2, c3, chance = of_word[codes], longer[: len(codes)], longer[len(codes) :], spelt[codes]
        own, trains = Learner(np.full((GATES, WAYS), 0.3)), ~np.array(head["held"], bool)
        for texts, _, _, decisions in _cut(c1, c2, c3, chance.view(np.float32), lengths, trains, n_train, n_docs):
            own.learn(_of_training(decisions, trains[texts]))
        state = [_stated(x) for x in (own.weights * own.seen[:, None], own.seen, own.counts, own.met, own.hits)]
        row = (head["doc_ids"], head["held"], head["lengths"], head["sizes"], packed(c1), packed(c2), packed(c3), packed(chance[c1 <= 1]), state)
        return pa.Table.from_batches([_batch(to_arrow_schema(COUNTED), row)])

    return place


def _groups(row: dict, n_train: int, n_docs: int, most: int = GROUP_TOKENS) -> Iterator[tuple[slice, np.ndarray, np.ndarray, Decisions]]:
    """A segment's texts, some at a time: which, their tokens' counts, their lengths, their decisions."""
    c1, c2, c3, lengths = (unpacked(row[x]) for x in ("c1", "c2", "c3", "lengths"))
    spelt = np.zeros(len(c1), np.float32)
    spelt[c1 <= 1] = unpacked(row["spelt"]).astype(np.uint32).view(np.float32)
    yield from _cut(c1, c2, c3, spelt, lengths, ~np.array(row["held"], bool), n_train, n_docs, most)


def _cut(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, spelt: np.ndarray, lengths: np.ndarray, trains: np.ndarray, n_train: int, n_docs: int, most: int = GROUP_TOKENS) -> Iterator[tuple[slice, np.ndarray, np.ndarray, Decisions]]:
    ends = np.cumsum(lengths)
    cuts = [*np.unique((ends - 1) // most, return_index=True)[1].tolist(), len(lengths)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        at = slice(int(ends[a] - lengths[a]), int(ends[z - 1]))
        yield slice(a, z), c1[at], lengths[a:z], Decisions(c1[at], c2[at], c3[at], spelt[at], lengths[a:z], trains[a:z], n_train, n_docs)


# ---- learning ----------------------------------------------------------------------------------------------------

STATE = T.StructType().add("part", "long").add("name", "string").add("value", "binary")


def _sum_state(table: pa.Table) -> pa.Table:
    """Sums one array of a model's state, counts in whole numbers and others in doubles."""
    total = sum((_unstated(x) for x in table.column("value").to_pylist()), start=0)
    return pa.Table.from_arrays([table.column("part")[:1], table.column("name")[:1], pa.array([_stated(total)], pa.binary())], names=["part", "name", "value"])


def _stated(x: np.ndarray) -> bytes:
    return b"n" + packed(x.ravel()) if x.dtype.kind in "iu" else b"x" + packed(np.ascontiguousarray(x, np.float64).ravel().view(np.uint64))


def _unstated(x: bytes) -> np.ndarray:
    return unpacked(x[1:]).astype(np.int64) if x[:1] == b"n" else unpacked(x[1:]).astype(np.uint64).view(np.float64)


def _summed(df: DataFrame, work) -> dict[str, np.ndarray]:
    """Sums the arrays that `work` makes of each partition, in a tree: no group meets more than about the root of the number of tasks."""
    from pyspark import TaskContext

    groups, schema = max(1, ceil(df.rdd.getNumPartitions() ** 0.5)), to_arrow_schema(STATE)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, value in work(batches):
            yield _batch(schema, (TaskContext.get().partitionId() % groups, name, _stated(value)))

    first = df.mapInArrow(each, STATE).groupBy("part", "name").applyInArrow(_sum_state, STATE)
    whole = first.withColumn("part", F.lit(0).cast("long")).groupBy("part", "name").applyInArrow(_sum_state, STATE)
    return {r["name"]: _unstated(bytes(r["value"])) for r in whole.collect()}  # a model of fixed size


def _known_words(batches: Iterator[pa.RecordBatch], most: int = 50_000, once: bool = False) -> Iterator[list[bytes]]:
    for row in chain.from_iterable(b.to_pylist() for b in batches):
        counts = unpacked(row["counts"]).tolist()
        words = [w for w, c in zip(unpacked_words(row["words"], row["n"]), counts, strict=True) if (c == 1 if once else c)]
        for at in range(0, len(words), most):
            yield words[at : at + most]


def fit_spelling(vocabulary: DataFrame) -> Spelling:
    """Every token of the training texts counts once: what is spelt later are tokens that are not among them.

    Weights are learnt from those that occur once, each predicted by all others (from all tokens, should none occur once).
    """

    def count(batches):
        counts, any_word = np.zeros((K, 2 << SLOT_BITS), np.int64), False
        for words in _known_words(batches):
            count_slots(words, counts)
            any_word = True
        if any_word:
            for k in range(K):
                for at in range(0, 2 << SLOT_BITS, BLOCK):
                    if counts[k, at : at + BLOCK].any():
                        yield f"{k}:{at}", counts[k, at : at + BLOCK]

    counts = np.zeros((K, 2 << SLOT_BITS))
    for name, value in _summed(vocabulary, count).items():
        k, at = map(int, name.split(":"))
        counts[k, at : at + BLOCK] = value
    weights, met, hits = spell_weights(), np.zeros((256, BUCKETS)), np.zeros((256, BUCKETS))
    given = vocabulary.sparkSession.sparkContext.broadcast(Spelling(counts, weights, met))

    def learn(batches):
        state = spell_weights(), np.full((SPELL_GATES, K), 1e-6), np.zeros(SPELL_GATES), np.zeros((256, BUCKETS)), np.zeros((256, BUCKETS))
        for words in _known_words(batches, once=once):
            learn_spelling(words, given.value.tables, *state)
        weights, _, seen, met, hits = state
        if seen.any():
            yield from {"weights": weights * seen[:, None], "seen": seen, "met": met, "hits": hits}.items()

    once = True
    if not (found := _summed(vocabulary, learn)):
        once = False
        found = _summed(vocabulary, learn)
    given.unpersist()
    if found:
        seen = found["seen"][:, None]
        weights = np.where(seen > 0, found["weights"].reshape(weights.shape) / np.maximum(seen, 1), weights)
        met, hits = found["met"].reshape(met.shape), found["hits"].reshape(met.shape)
    return Spelling(counts, weights, (hits + 2 * _centres()) / (met + 2))


def fit_mixing(counted: DataFrame) -> Mixing:
    """What the online passes over all segments' training texts learnt: counts are summed, each gate's weights averaged by what they met."""
    names = ("weights", "seen", "counts", "met", "hits")

    def add(batches):
        total: dict[str, np.ndarray] = {}
        for state in chain.from_iterable(b.column("state").to_pylist() for b in batches):
            for name, value in zip(names, map(_unstated, state), strict=True):
                total[name] = total.get(name, 0) + value
        yield from total.items()

    found = _summed(counted.select("state"), add)
    shapes = {"weights": (GATES, WAYS), "seen": (GATES,), "counts": (WAYS, 2 << WAY_BITS), "met": (GATES, BUCKETS), "hits": (GATES, BUCKETS)}
    weights, seen, counts, met, hits = (found[x].reshape(shapes[x]) if found else np.zeros(shapes[x]) for x in names)
    weights = np.where(seen[:, None] > 0, weights / np.maximum(seen[:, None], 1), 0.3)
    return Mixing(np.log((counts[:, 1::2] + DELTA) / (counts[:, ::2] + DELTA)), weights, (hits + 2 * _centres()) / (met + 2))


def _of_training(own: Decisions, trains: np.ndarray) -> Decisions:
    keep = trains[own.text]
    own.bit, own.gate, own.slots = own.bit[keep], own.gate[keep], [s[keep] for s in own.slots]
    return own


@dataclass
class Model:
    """What scoring needs beside the counts: sums over the training texts, and the mixing of decisions."""

    n_train: int
    n_types: int
    n_docs: int
    mixing: Mixing


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, Model]:
    """Counts at the places of all texts, as a work table, and the model of the training texts."""
    schemas = {kind: to_arrow_schema(kind) for kind in (SEGMENT, SENT, VALUES)}
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_ids"), (crc_remainder(quoted(id_col), 7) == 2).alias("held"), F.col(quoted(text_col)).alias("text"))
    segments = materialise(slim.mapInArrow(lambda it: _segments(it, schemas[SEGMENT]), SEGMENT), "segments")
    n_segments, n_tokens, n_distinct, n_docs = segments.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    word_buckets, buckets = max(least, ceil(n_distinct / BUCKET_ENTRIES)), max(least, ceil(2 * n_tokens / BUCKET_ENTRIES))
    width = min(63, ceil(log2(2 * n_tokens + 2)) + SPARE_BITS)
    sent = segments.select("segment", "n_distinct", "words", "train").mapInArrow(lambda it: _send_words(it, schemas[SENT], word_buckets), SENT)
    dealt = lambda df, key, n: df.repartition(max(1, min(n, MOST_PARTITIONS)), key).groupBy(key)  # noqa: E731, one key a task or little more
    vocabulary = materialise(dealt(sent, "bucket", word_buckets).applyInArrow(_gather_words, VOCABULARY), "vocabulary")
    n_train, n_types = vocabulary.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    spelling = docs.sparkSession.sparkContext.broadcast(fit_spelling(vocabulary.select("n", "words", "counts")))
    of_words = vocabulary.mapInArrow(lambda it: _spell(it, schemas[VALUES], spelling.value), VALUES)
    sent = segments.select("segment", "n_distinct", "held", "lengths", "codes", "words").mapInArrow(lambda it: _send_ngrams(it, schemas[SENT], buckets, width), SENT)
    of_ngrams = dealt(sent, "bucket", buckets).applyInArrow(_gather_ngrams, VALUES)
    values = of_words.unionAll(of_ngrams)
    heads = dealt(segments.drop("train"), "segment", n_segments)
    counted = heads.cogroup(dealt(values, "segment", n_segments)).applyInArrow(_counted(word_buckets, width, n_train, n_docs), COUNTED)
    counted = materialise(counted, "counted")
    return counted, Model(n_train, n_types, n_docs, fit_mixing(counted))


def _score(batches: Iterator[pa.RecordBatch], schema: pa.Schema, model: Model) -> Iterator[pa.RecordBatch]:
    for row in chain.from_iterable(b.to_pylist() for b in batches):
        sizes = unpacked(row["sizes"])
        for texts, c1, lengths, own in _groups(row, model.n_train, model.n_docs):
            total = model.mixing.log10(own)
            base = np.add.reduceat(np.log10((c1 + 1) / (model.n_train + 1.0 * (model.n_types + 1))), own.starts)
            known = np.add.reduceat((c1 > 0).astype(np.int64), own.starts)
            columns = [row["doc_ids"][texts], row["held"][texts], lengths, known, np.full(len(lengths), model.n_train), base, total, -total / np.log10(2) / sizes[texts]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def score_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    counted, model = fit(docs, text_col, id_col)
    given, schema = docs.sparkSession.sparkContext.broadcast(model), to_arrow_schema(OUT)
    return counted.drop("state").mapInArrow(lambda it: _score(it, schema, given.value), OUT)
