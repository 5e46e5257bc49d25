"""A lexicon of identifiers and labels, and query expansion by it."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain, takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def ids_by_label(names: DataFrame, stops: Sequence[str]) -> DataFrame:
    """label (lower-cased), ids: shared labels keep all ids; one-word stop labels and dotted ids lead nowhere."""
    label = F.lower("label")
    kept = names.where(~label.isin([s.lower() for s in stops]) & ~F.contains("id", F.lit(".")))
    return kept.groupBy(label.alias("label")).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def labels_by_id(names: DataFrame) -> DataFrame:
    return names.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def expand(text: str, labels: dict[str, list[str]], ids: dict[str, list[str]], pattern: str = X.IDENTIFIER) -> list[str]:
    """What a query lacks: labels of the ids that it names (`P14.1` and `P25i` name their base), then ids of the labels that it
    holds. A longer label claims its place, so that a shorter one inside it isn't taken; what the query holds anywhere, in any
    case, is never added.
    """
    lowered = text.lower()
    named = chain.from_iterable(labels.get(m[1], ()) for m in re.finditer(pattern, text))
    places = [(m.start(), m.end(), label) for label in ids if (m := re.search(rf"\b{re.escape(label)}\b", lowered))]
    claimed: list[tuple[int, int, str]] = []
    for start, end, label in sorted(places, key=lambda p: (-len(p[2]), p[2])):
        if all(end <= a or z <= start for a, z, _ in claimed):
            claimed.append((start, end, label))
    out: dict[str, str] = {}
    for term in chain(named, chain.from_iterable(ids[label] for _, _, label in claimed)):
        if term.lower() not in lowered:
            out.setdefault(term.lower(), term)
    return list(out.values())


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _held(text, longest):
    """What of a text can be a label: everything from one word boundary to another, up to the longest label."""
    lowered = (text or "").lower()
    ends = [m.start() for m in re.finditer(r"\b", lowered)]
    return sorted({lowered[a:z] for n, a in enumerate(ends) for z in takewhile(lambda z: z - a <= longest, ends[n:])})  # noqa: B023


def expanded(queries: DataFrame, names: DataFrame, stops: Sequence[str], pattern: str = X.IDENTIFIER) -> DataFrame:
    """query, text, terms for a batch of queries and a lexicon (id, label) of any size: joins find what of it each text names or holds."""

    @F.udf(T.ArrayType(T.StringType()), useArrow=True)
    def named(text):
        return sorted({m[1] for m in re.finditer(pattern, text or "")})

    @F.udf(T.ArrayType(T.StringType()), useArrow=True)
    def terms(text, labels, ids):
        return expand(text or "", {x["id"]: x["labels"] for x in labels or ()}, {x["label"]: x["ids"] for x in ids or ()}, pattern)

    names = names.select("id", "label").where("id IS NOT NULL AND label IS NOT NULL")
    texts = queries.select("text").where("text IS NOT NULL").distinct()
    asked = texts.select("text", F.explode(named("text")).alias("id"))
    own = labels_by_id(names.join(asked.select("id").distinct(), "id", "left_semi"))
    labels = asked.join(own, "id").groupBy("text").agg(F.collect_list(F.struct("id", "labels")).alias("own_labels"))
    longest = names.agg(F.coalesce(F.max(F.length(F.lower("label"))), F.lit(0)).alias("longest"))
    held = texts.crossJoin(longest).select("text", F.explode(_held("text", "longest")).alias("label"))
    there = names.join(held.select(F.col("label").alias("__l")).distinct(), F.lower("label") == F.col("__l"), "left_semi")
    ids = held.join(ids_by_label(there, stops), "label").groupBy("text").agg(F.collect_list(F.struct("label", "ids")).alias("own_ids"))
    known = queries.select("query", "text").join(labels, "text", "left").join(ids, "text", "left")
    return known.select("query", "text", F.array_join(terms("text", "own_labels", "own_ids"), ",").alias("terms"))
