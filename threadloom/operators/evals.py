"""Evaluation reports as conditional aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

REVIEW_TERMS = 3  # fixed value: shared terms from which a case counts as known
BUNDLE = 8  # fixed value: cases that a judge gets at once
BLOCK = 10_000  # terms that go out at once


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets agree fully."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def report(questions: DataFrame, answers: DataFrame, judgements: DataFrame, group: str) -> DataFrame:
    """By group: questions, answered, found, each verdict, bluffs (claimed as found, judged wrong)."""
    all_rows = questions.join(answers, "question_id", "left").join(judgements, "question_id", "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    verdict = lambda v: F.col("verdict") == v
    return all_rows.groupBy(group).agg(F.count(F.lit(1)).alias("questions"), n(F.col("found").isNotNull()).alias("answered"), n(F.col("found")).alias("found"), n(verdict("correct")).alias("correct"), n(verdict("partial")).alias("partial"), n(verdict("wrong")).alias("wrong"), n(F.col("found") & verdict("wrong")).alias("bluffs"))


def agreement(a: DataFrame, b: DataFrame, case: str, item: str) -> DataFrame:
    """case, jaccard, only_a, only_b, identical for cases that both runs have."""
    gather = lambda d, name: d.groupBy(case).agg(F.array_sort(F.collect_set(item)).alias(name))
    both = gather(a, "a").join(gather(b, "b"), case)
    return both.select(case, jaccard(F.col("a"), F.col("b")).alias("jaccard"), F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_except("b", "a")).alias("only_b"), (F.col("a") == F.col("b")).alias("identical"))


def rank_control(rankings: DataFrame, a: str, b: str) -> DataFrame:
    """a_first, b_first, adjacent, skew over rankings (arrays, best first) that hold both."""
    at = lambda x: F.array_position("ranking", x)
    own = rankings.where((at(a) > 0) & (at(b) > 0))
    first, second = F.count_if(at(a) < at(b)), F.count_if(at(a) > at(b))
    return own.agg(first.alias("a_first"), second.alias("b_first"), F.count_if(F.abs(at(a) - at(b)) == 1).alias("adjacent"), F.round(F.abs(first - second) / F.count(F.lit(1)), 6).alias("skew"))


def unpaired(a: DataFrame, b: DataFrame, case: str) -> DataFrame:
    """case, run (a or b): cases that only one of two runs has."""
    one, two = a.select(case).distinct(), b.select(case).distinct()
    return one.join(two, case, "left_anti").withColumn("run", F.lit("a")).unionByName(two.join(one, case, "left_anti").withColumn("run", F.lit("b")))


def bundles(rows: DataFrame, group: str, order: str, size: int = BUNDLE) -> DataFrame:
    """Adds bundle: rows of a group in order, so many to a judge."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("bundle", F.floor((n - 1) / size))


def case_totals(rows: DataFrame, case: str, **totals: Column) -> DataFrame:
    """A row of totals for each case, and one for all of them."""
    return rows.rollup(case).agg(*[c.alias(name) for name, c in totals.items()]).select(F.coalesce(case, F.lit("all")).alias("case_id"), *totals)


def first_places(rankings: DataFrame) -> DataFrame:
    """label, wins: how often each label stands first in a ranking."""
    return rankings.where(F.size("ranking") > 0).groupBy(F.get("ranking", 0).alias("label")).agg(F.count(F.lit(1)).alias("wins"))


def breadth_by_verdict(answers: DataFrame, breadths: list[str]) -> DataFrame:
    """verdict, and how many answers of each breadth it was given to. answers: verdict, breadth."""
    return answers.groupBy("verdict").pivot("breadth", breadths).count().na.fill(0)


def decoded(rankings: DataFrame, key: DataFrame) -> DataFrame:
    """case, place (from 1), run of rankings (case, ranking of slots) whose slots a key (case, slot, run) stands behind; unknown slots are left out."""
    slots = rankings.select("case", F.posexplode("ranking").alias("pos", "slot"))
    return slots.join(key, ["case", "slot"]).select("case", (F.col("pos") + 1).alias("place"), "run")


def class_counts(runs: DataFrame) -> DataFrame:
    """run, cases, mean, median, most, total of the classes that each run (run, case, class_id) proposed; the median is exact."""
    n = runs.groupBy("run", "case").agg(F.count_distinct("class_id").alias("n"))
    return n.groupBy("run").agg(F.count(F.lit(1)).alias("cases"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"), F.sum("n").alias("total"))


def class_history(runs: DataFrame, order: DataFrame) -> DataFrame:
    """case, run, n, before, change (percent) over the runs in order (run, ord): how each case's number of classes went on."""
    n = runs.groupBy("run", "case").agg(F.count_distinct("class_id").alias("n")).join(order, "run")
    w = Window.partitionBy("case").orderBy("ord")
    seen = n.withColumn("before", F.lag("n").over(w))
    return seen.select("case", "run", "n", "before", F.round(100.0 * (F.col("n") - F.col("before")) / F.col("before"), 3).alias("change"))


def retrieved(expected: DataFrame, cited: DataFrame) -> DataFrame:
    """question_id, retrieved: whether any expected source is among the cited ones (arrays gold and cited)."""
    return expected.join(cited, "question_id", "left").select("question_id", F.coalesce(F.arrays_overlap("gold", "cited"), F.lit(False)).alias("retrieved"))


def merged_questions(rows: DataFrame, required: list[str]) -> DataFrame:
    """question_id (slice-q1, ...) beside the columns of rows (slice, pos, ...): only rows that have all required fields count."""
    whole = rows
    for c in required:
        whole = whole.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    n = F.row_number().over(Window.partitionBy("slice").orderBy("pos"))
    return whole.withColumn("question_id", F.concat("slice", F.lit("-q"), n.cast("string")))


def cited_quotes(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """case_id, cited, unresolvable, quoted, contained of citations (case_id, id, quote) against sources (id, text): a quote counts as contained where its source holds it in match form."""
    met = citations.join(sources.select("id", F.lower(X.match_form("text")).alias("t")), "id", "left")
    has = F.coalesce(F.col("quote"), F.lit("")) != ""
    held = has & F.coalesce(F.contains("t", F.lower(X.match_form("quote"))), F.lit(False))
    return met.groupBy("case_id").agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.col("t").isNull()).alias("unresolvable"), F.count_if(has).alias("quoted"), F.count_if(held).alias("contained"))


def corpus_units(documents: DataFrame, messages: DataFrame) -> DataFrame:
    """unit (spec:id or mail:id), ord, text in small letters: what a case's terms are looked for in, documents first."""
    named = documents.select(F.concat(F.lit("spec:"), "chunk_id").alias("unit"), F.lit(0).alias("kind"), F.col("chunk_id").cast("string").alias("key"), F.lower("text").alias("text"))
    mail = messages.select(F.concat(F.lit("mail:"), F.col("id").cast("string")).alias("unit"), F.lit(1).alias("kind"), F.col("id").cast("string").alias("key"), F.lower("body").alias("text"))
    return named.unionByName(mail).select("unit", F.struct("kind", "key").alias("ord"), "text")


def _standing(terms: DataFrame, units: DataFrame) -> DataFrame:
    """run (words in a row, space-joined), unit, ord: which of the terms' words (w) stand in a row in which units, found within each unit.

    Terms go out in blocks of a fixed size; nothing but what is found leaves a task.
    """
    every = terms.select("w", F.array_join("w", " ").alias("run")).distinct()
    blocks, out = max(1, -(-every.count() // BLOCK)), None
    words = units.select("unit", "ord", X.tokens("text").alias("words")).where(F.size("words") > 0)
    schema = T.StructType([T.StructField("run", T.StringType()), *words.schema.fields[:2]])
    for block in range(blocks):
        own = every if blocks == 1 else every.where(F.pmod(F.xxhash64("run"), F.lit(blocks)) == block)
        asked = [list(r["w"]) for r in own.collect()]  # a block
        part = words.mapInArrow(lambda batches, asked=asked: _in_a_row(batches, asked), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _in_a_row(batches: Iterator[pa.RecordBatch], asked: list[list[str]], tokens: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    known = pa.array(sorted({w for run in asked for w in run}), pa.string())
    number = {w: k for k, w in enumerate(known.to_pylist())}
    runs, names = [np.array([number[w] for w in run]) for run in asked], [" ".join(run) for run in asked]
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch["words"]).to_numpy())
        cuts = np.flatnonzero(np.diff(ends // tokens)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            part = batch.slice(low, high - low)
            words = part["words"].flatten().dictionary_encode()
            of = pc.fill_null(pc.index_in(words.dictionary, value_set=known), -1).to_numpy()
            codes = of[words.indices.to_numpy()]
            rows = np.repeat(np.arange(len(part)), pc.list_value_length(part["words"]).to_numpy())
            places = np.flatnonzero(codes >= 0)
            order = places[np.argsort(codes[places], kind="stable")]
            begins = np.searchsorted(codes[order], np.arange(len(known) + 1))
            count = np.diff(begins)
            found, which = [], []
            for k, run in enumerate(runs):
                rare = int(np.argmin(count[run]))
                at = order[begins[run[rare]] : begins[run[rare] + 1]] - rare
                at = at[(at >= 0) & (at + len(run) <= len(codes))]
                for j, code in enumerate(run):
                    at = at[codes[at + j] == code]
                at = at[rows[at] == rows[at + len(run) - 1]]
                if len(at):
                    found.append(np.unique(rows[at]))
                    which.append(np.full(len(found[-1]), k))
            if found:
                at = pa.array(np.concatenate(found))
                run = pa.array(names, pa.string()).take(pa.array(np.concatenate(which)))
                yield from pa.table([run, part["unit"].take(at), part["ord"].take(at)], names=["run", "unit", "ord"]).to_batches(max_chunksize=100_000)


def phrase_novelty(terms: DataFrame, units: DataFrame, least: int = REVIEW_TERMS) -> DataFrame:
    """The same as novelty for terms of any number of words, which must stand in a row. units: unit, ord, text."""
    own = terms.select("case", "term", X.tokens("term").alias("w")).where(F.size("w") > 0).distinct()
    runs = own.select("case", "term", F.array_join("w", " ").alias("run")).join(_standing(own, units), "run")
    shared = runs.select("case", "term", "unit", "ord").distinct().groupBy("case", "unit", "ord").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("case").agg(F.min(F.struct((-F.col("shared")).alias("m"), "ord", "unit")).alias("b"))
    return best.select("case", "b.unit", (-F.col("b.m")).alias("shared")).withColumn("verdict", F.when(F.col("shared") >= least, "REVIEW").otherwise("novel"))


def novelty(terms: DataFrame, units: DataFrame, least: int = REVIEW_TERMS) -> DataFrame:
    """case, unit, shared, verdict: the first unit that holds the most of a case's terms. terms: case, term; units: unit, ord, words."""
    words = units.select("unit", "ord", F.explode(F.array_distinct("words")).alias("term"))
    shared = terms.distinct().join(words, "term").groupBy("case", "unit", "ord").agg(F.count(F.lit(1)).alias("shared"))
    w = Window.partitionBy("case").orderBy(F.desc("shared"), "ord")
    best = shared.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "ord")
    return best.withColumn("verdict", F.when(F.col("shared") >= least, "REVIEW").otherwise("novel"))


def sibling_compliance(proposed: DataFrame, siblings: DataFrame, considered: DataFrame) -> DataFrame:
    """case, ok, total: proposed classes that have siblings, and those of which at least one sibling was considered."""
    have = proposed.distinct().join(siblings.select(F.col("id").alias("class_id")).distinct(), "class_id", "left_semi")
    met = considered.join(siblings.select(F.col("id").alias("class_id"), "sibling"), ["class_id", "sibling"]).select("case", "class_id").distinct().withColumn("met", F.lit(True))
    return have.join(met, ["case", "class_id"], "left").groupBy("case").agg(F.count_if(F.coalesce("met", F.lit(False))).alias("ok"), F.count(F.lit(1)).alias("total"))
