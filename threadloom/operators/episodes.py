"""Episodes: prompts of eligible threads, and what comes back for them, checked against threads, messages and the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .family import checked_ids

# What an outcome and a confidence may be, and what anything else becomes.
OUTCOMES, CONFIDENCES = ("decided", "unresolved", "informational"), ("high", "medium", "low")
OUTCOME_ELSE, CONFIDENCE_ELSE = "informational", "medium"
RESULT = "struct<episodes: array<struct<topic: string, question: string, message_indexes: array<int>, positions: array<struct<who: string, position: string>>, outcome: string, outcome_detail: string, entities: array<string>, confidence: string>>>"


def coerced(value: Column, allowed: tuple[str, ...], other: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(other)


def thread_members(members: DataFrame, messages: DataFrame, least: int = 2) -> DataFrame:
    """thread, ids: the messages that exist of every thread with at least `least` members, in order. Prompts and results both count in it."""
    sizes = members.groupBy("thread").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("thread")
    there = members.join(sizes, "thread", "left_semi").join(messages.select("id"), "id", "left_semi")
    ids = there.groupBy("thread").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "id"))), lambda x: x["id"]).alias("ids"))
    none = F.array().cast(f"array<{members.schema['id'].dataType.simpleString()}>")
    return sizes.join(ids, "thread", "left").select("thread", F.coalesce("ids", none).alias("ids"))


def prompts(members: DataFrame, messages: DataFrame, least: int = 2) -> DataFrame:
    """thread, prompt, chars of every eligible thread. messages: id, date, from_name, from_email, subject, body."""
    whole = thread_members(members, messages, least).select("thread", F.size("ids").alias("n"), F.posexplode_outer("ids").alias("pos", "id")).join(messages, "id", "left")
    head = F.concat(F.lit("--- ["), F.col("pos").cast("string"), F.lit("] "), F.substring(F.coalesce("date", F.lit("")), 1, 10), F.lit(" | "), F.coalesce(F.nullif("from_name", F.lit("")), "from_email", F.lit("")), F.lit(" | "), F.coalesce("subject", F.lit("")), F.lit(" ---\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    parts = whole.groupBy("thread", "n").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", head.alias("t"))))), lambda x: x["t"]).alias("parts"))
    title = F.concat(F.lit("### Thread "), F.col("thread"), F.lit(" ("), F.col("n").cast("string"), F.lit(" messages)\n"))
    prompt = F.array_join(F.concat(F.array(title), "parts"), "\n")
    return parts.select("thread", prompt.alias("prompt")).withColumn("chars", F.length("prompt"))


def collect(results: DataFrame, members: DataFrame, messages: DataFrame, current: DataFrame, former: DataFrame, added: DataFrame, least: int = 2) -> dict[str, DataFrame]:
    """Episodes from results (shard, thread, result as JSON), and what is wrong: errors (shard, thread, error) and missing threads.

    Malformed results and unknown threads are errors, never fatal. Indexes outside the thread are left out; without any, the episode
    has all its messages. Values that aren't allowed become the default and are counted; ids are sorted into current,
    historical, extension and bogus ones.
    """
    known = members.select("thread", F.lit(True).alias("known")).distinct()
    read = results.select("shard", "thread", F.from_json("result", RESULT, {"mode": "PERMISSIVE"}).alias("r")).join(known, "thread", "left")
    broken = F.col("r.episodes").isNull()
    errors = read.where(broken | F.col("known").isNull()).select("shard", "thread", F.when(F.col("known").isNull(), "unknown thread").otherwise("unparseable").alias("error"))
    whole = thread_members(members, messages, 1)
    rows = read.where(~broken & F.col("known").isNotNull()).select("thread", F.posexplode("r.episodes").alias("n", "e")).join(whole, "thread")
    rows = rows.withColumn("episode_id", F.concat("thread", F.lit("-e"), (F.col("n") + 1).cast("string")))
    chosen = F.transform(F.filter(F.coalesce("e.message_indexes", F.array().cast("array<int>")), lambda i: (i >= 0) & (i < F.size("ids"))), lambda i: F.get("ids", i))
    rows = rows.withColumn("message_ids", F.when(F.size(chosen) > 0, chosen).otherwise(F.col("ids")))
    who = F.coalesce(F.nullif("from_name", F.lit("")), "from_email", F.lit(""))
    seen = rows.select("episode_id", F.explode("message_ids").alias("id")).join(messages.select("id", "date", who.alias("who")), "id")
    facts = seen.groupBy("episode_id").agg(F.min("date").alias("date_start"), F.max("date").alias("date_end"), F.array_sort(F.collect_set(F.nullif("who", F.lit("")))).alias("participants"))
    ids = checked_ids(rows.select("episode_id", F.coalesce("e.entities", F.array().cast("array<string>")).alias("raw")), "episode_id", "raw", current, former, added)
    outcome, confidence = coerced(F.col("e.outcome"), OUTCOMES, OUTCOME_ELSE), coerced(F.col("e.confidence"), CONFIDENCES, CONFIDENCE_ELSE)
    changed = (~F.coalesce(F.col("e.outcome").isin(*OUTCOMES), F.lit(False))).cast("int") + (~F.coalesce(F.col("e.confidence").isin(*CONFIDENCES), F.lit(False))).cast("int")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    episodes = rows.join(facts, "episode_id", "left").join(ids, "episode_id", "left").select(
        "episode_id", "thread", "message_ids", "date_start", "date_end", F.coalesce("participants", F.array().cast("array<string>")).alias("participants"), text("e.topic").alias("topic"), text("e.question").alias("question"),
        F.coalesce("e.positions", F.array().cast("array<struct<who: string, position: string>>")).alias("positions"), F.coalesce(outcome, F.lit(OUTCOME_ELSE)).alias("outcome"), text("e.outcome_detail").alias("outcome_detail"),
        F.col("current").alias("entities"), F.col("historical").alias("entities_historical"), F.col("extension").alias("entities_extension"), "bogus", F.coalesce(confidence, F.lit(CONFIDENCE_ELSE)).alias("confidence"), changed.alias("coerced"),
    )
    missing = members.groupBy("thread").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("thread").join(episodes.select("thread").distinct(), "thread", "left_anti")
    return {"episodes": episodes, "errors": errors, "missing": missing}


def held_in(episodes: DataFrame, concept: str) -> DataFrame:
    """Episodes that name a concept in any way, oldest first, undated ones before all; no more than a day of their dates is told."""
    every = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("entities", "entities_historical", "entities_extension")])
    return episodes.where(F.array_contains(every, concept)).select("episode_id", "topic", X.day_of("date_start").alias("day"), F.coalesce("date_start", F.lit("")).alias("date_start")).orderBy("date_start", "episode_id")
