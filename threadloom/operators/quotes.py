"""Verification of quotations by containment, with elisions, context and the closest wording where there is none."""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.rows import per_row, per_row_of_two, slices
from .worktables import materialise

# Elision marks, words that a fragment needs, characters of context, least partial match.
ELISION = r"\s*(?:\.\.\.|…|\[[^\]]*\])\s*"
FRAGMENT_WORDS, PAD, PARTIAL_CHARS = 4, 60, 25
GRAM = 5
MOST_SHORT = 10_000  # short phrases that are looked for in every text
SPAN_ELISION = r"\s*(?:\.\.\.|\[[^\]]*\])\s*"
_PLAIN_MARKS = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "—": "-", "–": "-", "…": "...", "\u00a0": " "})
TERM_LETTERS, RUN = 7, 4  # what a text and a phrase must share to be compared
TAIL, SLOTS = 8, 20  # characters of a window that are looked for first, bits of the numbers that they get


def _locate(part: Column, text: Column, start: Column) -> Column:
    """1-based place of `part` at or after `start`, 0 if there is none."""
    return F.call_function("locate", part, text, start)


def fragments(phrase: Column) -> Column:
    return F.filter(F.split(phrase, ELISION), lambda f: F.trim(f) != "")


def elided_span(text: Column, phrase: Column) -> Column:
    """(start, end), 1-based, of fragments that follow each other without overlap; null if one is missing or too short."""
    parts = fragments(phrase)
    step = lambda s, f: F.when(s["end"] == -1, s).otherwise(
        F.when(_locate(f, text, s["end"]) == 0, F.struct(s["start"].alias("start"), F.lit(-1).alias("end"))).otherwise(
            F.struct(F.when(s["start"] == 0, _locate(f, text, s["end"])).otherwise(s["start"]).alias("start"), (_locate(f, text, s["end"]) + F.length(f)).alias("end"))))
    found = F.aggregate(parts, F.struct(F.lit(0).alias("start"), F.lit(1).alias("end")), step)
    weighty = (F.size(parts) >= 2) & F.forall(parts, lambda f: F.size(F.split(F.trim(f), r"\s+")) >= FRAGMENT_WORDS)
    return F.when(weighty & (found["end"] > 0), found)


def context(text: Column, start: Column, end: Column, pad: int = PAD) -> Column:
    """The span in its surroundings: **marked**, with … where the text goes on."""
    low, high = F.greatest(F.lit(1), start - pad), F.least(F.length(text) + 1, end + pad)
    cut = lambda a, z: F.substring(text, a, z - a)
    return F.concat(F.when(low > 1, "…").otherwise(""), cut(low, start), F.lit("**"), cut(start, end), F.lit("**"), cut(end, high), F.when(high <= F.length(text), "…").otherwise(""))


def contained(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """phrase_id, text_id, start, context for phrases (phrase_id, phrase) that texts (text_id, text) hold whole, in match form and any case.

    Phrases of seven words or more meet texts by a gram of inner words, an equi-join of the texts' grams that are asked for; shorter
    ones, MOST_SHORT at most, are checked against every text in one broadcast.
    """
    words = lambda c: F.split(c, " ")
    p = phrases.select("phrase_id", F.lower(X.match_form("phrase")).alias("p")).where("p <> ''")
    # the forms are written: a join would work out their expressions again for every pair
    t = materialise(texts.select("text_id", X.match_form("text").alias("t")), "forms")
    long = p.where(F.size(words("p")) >= GRAM + 2).withColumn("gram", F.xxhash64(*[F.get(words("p"), k) for k in range(1, GRAM + 1)]))
    own = t.select("text_id", words(F.lower("t")).alias("w")).where(F.size("w") >= GRAM)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - GRAM), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(GRAM)]))
    keys = own.select("text_id", F.explode(F.array_distinct(grams)).alias("gram")).join(long.select("gram").distinct(), "gram", "left_semi")
    met = long.join(keys, "gram").select("phrase_id", "p", "text_id").distinct().join(t, "text_id")
    few = p.where(F.size(words("p")) < GRAM + 2)
    if few.limit(MOST_SHORT + 1).count() > MOST_SHORT:
        raise ValueError(f"more than {MOST_SHORT} phrases of fewer than {GRAM + 2} words; ask in batches")
    short = t.join(F.broadcast(few), F.contains(F.lower("t"), F.col("p"))).select("text_id", "phrase_id", "p", "t")
    found = met.unionByName(short).withColumn("start", _locate(F.col("p"), F.lower("t"), F.lit(1))).where("start > 0")
    return found.select("phrase_id", "text_id", "start", context(F.col("t"), F.col("start"), F.col("start") + F.length("p")).alias("context"))


def _form(text: str) -> str:
    for mark, plain in zip(X.TYPOGRAPHIC, X.PLAIN, strict=True):
        text = text.replace(mark, plain)
    return re.sub(r"\s+([.,;:?!])", r"\1", re.sub(r"\s+", " ", text)).strip().lower()


def _tails(text: str) -> np.ndarray:
    """A number of SLOTS for every TAIL characters in a row."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(codes) - TAIL + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(TAIL):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOTS)).astype(np.int64)


@lru_cache(maxsize=1)
def _text_form(text: str) -> tuple[str, np.ndarray]:
    """A text's form and which numbers its runs of TAIL characters have."""
    form, there = _form(text), np.zeros(1 << SLOTS, bool)
    there[_tails(form)] = True
    return form, there


@lru_cache(maxsize=1000)
def _phrase_form(phrase: str) -> tuple[str, np.ndarray]:
    form = _form(phrase)
    return form, _tails(form)


def longest_run(a: str, b: str, maybe: list[bool] | None = None) -> int:
    """Length of the longest run of characters that stands in both.

    A window is one longer than the best run so far. Where b lacks the window's last characters, no window that holds them can be
    there, so the search goes on behind their begin. maybe: for every TAIL characters of a, False where b lacks them for sure.
    """
    if a in b:
        return len(a)
    best = at = 0
    if maybe and any(m and a[i : i + TAIL] in b for i, m in enumerate(maybe)):
        best = TAIL
    while at + best < len(a):
        end, tail = at + best + 1, min(TAIL, best + 1)
        if (maybe and tail == TAIL and not maybe[end - TAIL]) or a[end - tail : end] not in b:
            at = end - tail + 1
        elif a[at:end] in b:
            best = bisect.bisect_left(range(best + 2, len(a) - at + 1), True, key=lambda n: a[at : at + n] not in b) + best + 1  # noqa: B023
            at += 1
        else:
            at = end - tail - bisect.bisect_left(range(tail + 1, best + 1), True, key=lambda n: a[end - n : end] not in b)  # noqa: B023
    return best


def closest(text: str, phrase: str) -> float:
    """Share of the phrase that the text holds as one run of characters."""
    (a, tails), (b, there) = _phrase_form(phrase), _text_form(text)
    return round(longest_run(a, b, there[tails].tolist()) / len(a), 3) if a and b else 0.0


closest_udf = per_row_of_two(lambda text, phrase: closest(text or "", phrase or ""), T.DoubleType())


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id for all texts (doc_id, text) and phrases (item_id, phrase; short phrases are bounded) that share, anywhere
    in either, a term of more than TERM_LETTERS letters or RUN tokens in a row; a phrase of fewer tokens is shared whole."""
    features = lambda words: F.explode(F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) > TERM_LETTERS), F.when(F.size(words) >= RUN, F.transform(F.sequence(F.lit(1), F.size(words) - RUN + 1), lambda k: F.array_join(F.slice(words, k, RUN), " "))).otherwise(F.array().cast("array<string>")))))
    d, i = docs.select("doc_id", X.tokens("text").alias("w")), items.select("item_id", X.tokens("phrase").alias("w"))
    met = d.select("doc_id", features(F.col("w")).alias("f")).join(i.select("item_id", features(F.col("w")).alias("f")), "f").select("doc_id", "item_id")
    padded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    short = i.where((F.size("w") > 0) & (F.size("w") < RUN)).select("item_id", padded(F.col("w")).alias("p"))
    if short.limit(MOST_SHORT + 1).count() > MOST_SHORT:
        raise ValueError(f"more than {MOST_SHORT} short phrases; ask in batches")
    whole = d.select("doc_id", padded(F.col("w")).alias("t")).join(F.broadcast(short), F.contains("t", "p")).select("doc_id", "item_id")
    return met.unionByName(whole).distinct()


def verdicts(spans: DataFrame, units: DataFrame, least: int = PARTIAL_CHARS) -> DataFrame:
    """span_id, status, how, prefix_chars: matched (literal, or elided where every part of four words or more stands somewhere),
    else partial with the longest begin of the first missing part that stands somewhere, or absent if that is under `least` characters.

    spans: span_id, span; units: unit_id, text. The form of both folds compatible characters, marks, spaces and case.
    """
    units = materialise(units.select("unit_id", norm_udf("text").alias("text")), "units")
    asked = materialise(spans.select("span_id", norm_udf("span").alias("span")), "spans")
    parts = asked.select("span_id", F.posexplode(F.filter(F.split("span", SPAN_ELISION), lambda f: F.size(F.split(F.trim(f), " ")) >= FRAGMENT_WORDS)).alias("pos", "part"))
    needles = asked.select(F.col("span").alias("part")).unionByName(parts.select("part")).distinct()
    there = _begins(needles, units)
    whole = asked.join(there.withColumnRenamed("part", "span"), "span").select("span_id", "span", (F.col("prefix") == F.length("span")).alias("literal"), F.col("prefix").alias("own_prefix"))
    met = parts.join(there, "part").withColumn("held", F.col("prefix") == F.length("part"))
    fragments = met.groupBy("span_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("held").alias("all_held"), F.min_by("prefix", F.when(~F.col("held"), F.col("pos"))).alias("missing"))
    joined = whole.join(fragments, "span_id", "left")
    elided = (F.coalesce("n", F.lit(0)) > 1) & F.coalesce("all_held", F.lit(False))
    prefix = F.coalesce("missing", "own_prefix")
    status = F.when(F.col("literal") | elided, "matched").when(prefix < least, "absent").otherwise("partial")
    how = F.when(F.col("literal"), "literal").when(elided, "elided")
    return joined.select("span_id", status.alias("status"), how.alias("how"), F.when(~(F.col("literal") | elided), prefix).alias("prefix_chars"))


def _begins(needles: DataFrame, units: DataFrame, gram: int = 12) -> DataFrame:
    """part, prefix: how many of a needle's first characters stand together in some unit.

    One automaton over the needles' first `gram` characters goes once through every unit; each place that it finds is followed as far
    as the needle goes. A begin of fewer characters counts as none: it is far below what makes a partial match. Needles go out in
    blocks of a fixed size.
    """
    blocks, found = max(1, -(-needles.count() // MOST_SHORT)), None
    schema = "part string, prefix int"
    for block in range(blocks):
        own = needles if blocks == 1 else needles.where(F.pmod(F.xxhash64("part"), F.lit(blocks)) == block)
        asked = sorted({r["part"] for r in own.collect() if r["part"]})  # a block
        part = units.select("text").mapInArrow(lambda it, asked=asked: _followed(it, asked, gram), schema)
        found = part if found is None else found.unionByName(part)
    most = found.groupBy("part").agg(F.max("prefix").alias("prefix"))
    return needles.join(most, "part", "left").select("part", F.coalesce("prefix", F.lit(0)).alias("prefix"))


def _followed(batches: Iterator[pa.RecordBatch], asked: list[str], gram: int) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    begins: dict[str, list[str]] = {}
    for needle in asked:
        begins.setdefault(needle[:gram], []).append(needle)
    machine = ahocorasick.Automaton()
    for begin in begins:
        machine.add_word(begin, begin)
    machine.make_automaton()
    best: dict[str, int] = {}
    for batch in batches:
        for text in filter(None, chain.from_iterable(values for (values,) in slices(batch.column("text"))) if asked else ()):
            for end, begin in machine.iter(text):
                start = end + 1 - len(begin)
                for needle in begins[begin]:
                    n = best.get(needle, 0)
                    while n < len(needle) and text.startswith(needle[: n + 1], start):
                        n += 1
                    if n > best.get(needle, 0):
                        best[needle] = n
    yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array(list(best.values()), pa.int32())], names=["part", "prefix"])


def longest_prefix(needle: str, text: str) -> int:
    """Length of the longest begin of the needle that the text holds, by halving."""
    return bisect.bisect_left(range(1, len(needle) + 1), True, key=lambda n: needle[:n] not in text)


def norm(text: str) -> str:
    """Form in which spans are compared: compatible characters, plain marks and dashes, single spaces, none before punctuation, small letters."""
    plain = unicodedata.normalize("NFKD", text or "").translate(_PLAIN_MARKS)
    return re.sub(r"\s+([.,;:?!])", r"\1", re.sub(r"\s+", " ", plain)).lower()


norm_udf = per_row(norm, T.StringType())


def json_strings(document: str) -> list[str]:
    """Every string value of a JSON document, however deep, in order."""
    out, todo = [], [json.loads(document)]
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            out.append(value)
        elif isinstance(value, (list, dict)):
            todo += reversed(list(value.values()) if isinstance(value, dict) else value)
    return out


json_strings_udf = per_row(lambda d: json_strings(d) if d else [], T.ArrayType(T.StringType()))


def find_quotes(asked: DataFrame, members: DataFrame, episodes: DataFrame, messages: DataFrame, documents: DataFrame) -> DataFrame:
    """source_id, phrase, source_kind, found, text_id, index, start, context, score: whether each source holds the phrase, and where.

    A source is a thread, an episode, a document chunk or a message (by id or Message-ID), in this order; an unknown one has kind
    null. The first message of a source that holds the phrase counts; if none does, the closest of all its texts is told with its
    score. An index counts in the whole thread. asked: source_id, phrase; members: thread, id, index; episodes: episode_id, thread,
    ids; messages: id, message_id, body; documents: chunk_id, text.
    """
    if not asked.where(F.trim(F.coalesce("phrase", F.lit(""))) == "").isEmpty():
        raise ValueError("a phrase must not be empty")
    own = asked.select("source_id", "phrase", F.trim("source_id").alias("key")).distinct()
    text_of = messages.select("id", F.coalesce("body", F.lit("")).alias("text"))
    in_episode = episodes.select("episode_id", "thread", F.posexplode("ids").alias("place", "id")).join(members, ["thread", "id"], "left")
    row = lambda prio, kind, key, text_id, place, index: [F.lit(prio).alias("prio"), F.lit(kind).alias("source_kind"), F.col(key).alias("key"), F.col(text_id).alias("text_id"), place.alias("place"), index.alias("index")]
    none = F.lit(None).cast("int")
    sources = members.select(*row(0, "thread", "thread", "id", F.col("index").cast("int"), F.col("index").cast("int")))
    sources = sources.unionByName(in_episode.select(*row(1, "episode", "episode_id", "id", F.col("place").cast("int"), F.col("index").cast("int"))))
    sources = sources.unionByName(documents.select(*row(2, "document", "chunk_id", "chunk_id", F.lit(1), none)))
    sources = sources.unionByName(messages.select(*row(3, "message", "id", "id", F.lit(1), none))).unionByName(messages.select(*row(4, "message", "message_id", "id", F.lit(1), none)))
    met = own.join(sources, "key")
    first = met.groupBy("source_id", "phrase").agg(F.min("prio").alias("prio"))
    kept = met.join(first, ["source_id", "phrase", "prio"])
    texts = text_of.unionByName(documents.select(F.col("chunk_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))).withColumnRenamed("id", "text_id")
    seen = kept.join(texts, "text_id").withColumn("t", X.match_form("text")).withColumn("p", F.lower(X.match_form("phrase")))
    elided = elided_span(F.lower("t"), F.col("p"))
    at = _locate(F.col("p"), F.lower("t"), F.lit(1))
    seen = seen.withColumn("start", F.when(at > 0, at).otherwise(elided["start"])).withColumn("end", F.when(at > 0, at + F.length("p")).otherwise(elided["end"]))
    judged = seen.withColumn("score", F.when(F.col("start").isNull(), closest_udf("text", "phrase"))).withColumn("context", F.when(F.col("start").isNotNull(), context(F.col("t"), F.col("start"), F.col("end"))))
    order = F.struct(F.col("start").isNull().alias("miss"), F.when(F.col("start").isNull(), -F.col("score")).alias("far"), "place", "text_id", "index", "start", "context", "score", "source_kind")
    best = judged.groupBy("source_id", "phrase").agg(F.min(order).alias("b"))
    out = own.join(best, ["source_id", "phrase"], "left")
    kinds = first.join(met.select("source_id", "phrase", "prio", F.col("source_kind").alias("kind")).distinct(), ["source_id", "phrase", "prio"]).select("source_id", "phrase", "kind")
    return out.join(kinds, ["source_id", "phrase"], "left").select("source_id", "phrase", F.col("kind").alias("source_kind"), F.coalesce(~F.col("b.miss"), F.lit(False)).alias("found"), "b.text_id", "b.index", "b.start", "b.context", "b.score")


def first_hits(found: DataFrame, order: str) -> DataFrame:
    """The first text in order that holds each phrase."""
    w = Window.partitionBy("phrase_id").orderBy(order, "text_id")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
