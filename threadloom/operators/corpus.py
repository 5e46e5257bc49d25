"""Corpus operators: deduplication, page furniture, sessions, sections, threads, issue indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.cleaning import COUNTERS, clean_body_udf
from .components import components
from .worktables import global_rank, materialise

DAY_MICROS = 86_400_000_000
# Fixed values of threading and page cleaning.
GAP_DAYS = 30
PROBE_CHARS = 200
FURNITURE_SHARE, FURNITURE_CHARS, FURNITURE_PAGES = 0.5, 90, 3


def lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per line with its place (from 0)."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds first_id and is_duplicate: the first row of a key stays. Partial aggregation, so hot keys don't gather."""
    first = df.groupBy(key).agg(F.min(order).alias("first_id"))
    return df.join(first, key).withColumn("is_duplicate", F.col(order) != F.col("first_id"))


def duplicate_groups(df: DataFrame, key: Column, member: str) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(member)).alias("members")).where(F.size("members") > 1)


def repeated_paragraphs(paragraphs: DataFrame, doc: str, text: str) -> DataFrame:
    """Adds `dropped`: the paragraph's key stands in an earlier document already."""
    keyed = paragraphs.withColumn("key", X.paragraph_key(text))
    first = keyed.groupBy("key").agg(F.min(doc).alias("first_doc"))
    return keyed.join(first, "key").withColumn("dropped", F.col(doc) > F.col("first_doc"))


def furniture(pages: DataFrame, document: str, page: str, text: str, share: float = FURNITURE_SHARE, chars: int = FURNITURE_CHARS, least: int = FURNITURE_PAGES) -> DataFrame:
    """(document, line): short lines on more than `share` of a document's pages; without_furniture also drops bare page numbers."""
    own = lines(pages, text, document, page).select(document, page, X.collapsed("line").alias("line")).where((F.col("line") != "") & (F.length("line") < chars)).distinct()
    counts = own.groupBy(document, "line").agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy(document).agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    return counts.join(sizes, document).where(F.col("n") > F.col("pages") * share).select(document, "line", "n")


def without_furniture(pages: DataFrame, document: str, page: str, text: str, **limits) -> DataFrame:
    """(document, page, pos, line) of the lines that stay: neither repeated on most pages nor, from three pages on, a bare page number."""
    found = furniture(pages, document, page, text, **limits).select(document, F.col("line").alias("key"))
    enough = pages.groupBy(document).agg((F.count(F.lit(1)) >= limits.get("least", FURNITURE_PAGES)).alias("enough"))
    own = lines(pages, text, document, page).withColumn("key", X.collapsed("line")).join(enough, document)
    kept = own.where(~(F.col("enough") & F.col("line").rlike(r"^\s*\d{1,3}\s*$")))
    return kept.join(found, [document, "key"], "left_anti").select(document, page, "pos", "line")


def meetings_by_issue(links: DataFrame) -> DataFrame:
    """issue, meetings: those that took it up (doc_id, title, date, heading, chunk_id), in the order of their dates."""
    row = F.struct(X.meeting_key("date").alias("key"), F.col("place"), *[F.col(c) for c in ("doc_id", "title", "date", "heading", "chunk_id")])
    found = links.groupBy("issue").agg(F.array_sort(F.collect_list(row)).alias("m"))
    return found.select("issue", F.transform("m", lambda m: F.struct(*[m[c].alias(c) for c in ("doc_id", "title", "date", "heading", "chunk_id")])).alias("meetings"))


def has_page_content(outcome: str = "outcome", background: str = "background", *lists: str) -> Column:
    """Whether a page has anything to show: a text, or a list that isn't empty."""
    out = (F.coalesce(F.col(outcome), F.lit("")) != "") | (F.coalesce(F.col(background), F.lit("")) != "")
    for c in lists:
        out = out | (F.coalesce(F.size(F.col(c)), F.lit(0)) > 0)
    return out


def threads_in_years(members: DataFrame, first: int, last: int, least: int) -> DataFrame:
    """thread, n, first_year, last_year of threads (thread, id, date) with a message in the years and at least `least` messages."""
    year = X.year_of("date")
    sizes = members.groupBy("thread").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(year > 0, year)).alias("first_year"), F.max(year).alias("last_year"), F.bool_or(year.between(first, last)).alias("there"))
    return sizes.where(F.col("there") & (F.col("n") >= least)).drop("there")


def audit_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows for an audit, the same ones whenever it is asked: those with the least seeded hash of their key."""
    return df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def clean_messages(raw: DataFrame, marker: str, known: Column, pattern: str = X.IDENTIFIER) -> DataFrame:
    """Cleaned messages, one for each Message-ID (the first by place; one without an id is a message of its own).

    raw: place (0, 1, ...), message_id, date, from_name, from_email, subject, in_reply_to, references, body. Adds id (hash of the
    Message-ID), subject_norm, body without boilerplate and quotations, body_raw, spans, stripped (counts by rule), is_duplicate,
    and entities: current ones of body and subject; former ones of body, quotations and subject.
    """
    own = raw.withColumn("message_id", F.coalesce(F.nullif(F.trim("message_id"), F.lit("")), F.concat(F.lit("__no_id_"), F.col("place").cast("string"))))
    own = own.join(own.groupBy("message_id").agg(F.min("place").alias("first_place")), "message_id")
    cleaned = own.withColumn("c", clean_body_udf(marker)("body")).withColumn("subject", F.coalesce("subject", F.lit("")))
    ids = lambda c: X.known_and_former(X.identifiers(c, pattern), known)
    found = cleaned.withColumn("b", ids("c.body")).withColumn("s", ids("subject")).withColumn("q", ids("c.quoted"))
    both = lambda *parts: F.array_sort(F.array_distinct(F.concat(*parts)))
    spans = F.filter(F.array(X.collapsed("c.quoted")), lambda x: x != "")
    return found.select(X.hash_id("message_id").alias("id"), "message_id", "date", "from_name", "from_email", "subject", X.subject_key("subject").alias("subject_norm"), "in_reply_to", "references", F.col("c.body").alias("body"), F.col("body").alias("body_raw"), spans.alias("spans"), F.col("c.quote_spans").alias("quote_spans"), F.col("c.stripped").alias("stripped"), both("b.current", "s.current").alias("entities"), both("b.historical", "q.historical", "s.historical").alias("entities_historical"), (F.col("place") != F.col("first_place")).alias("is_duplicate"))


def clean_stats(cleaned: DataFrame) -> DataFrame:
    """messages, duplicates, raw_chars, clean_chars, reduction (percent), and how often each rule applied, over what clean_messages gives."""
    kept, counts = ~F.col("is_duplicate"), [F.coalesce(F.sum(F.when(~F.col("is_duplicate"), F.col("stripped")[k])), F.lit(0)).alias(k) for k in COUNTERS]
    raw, clean = F.coalesce(F.sum(F.when(kept, F.length("body_raw"))), F.lit(0)), F.coalesce(F.sum(F.when(kept, F.length("body"))), F.lit(0))
    return cleaned.agg(F.count(F.lit(1)).alias("messages"), F.count_if("is_duplicate").alias("duplicates"), raw.alias("raw_chars"), clean.alias("clean_chars"), F.round(100.0 * (raw - clean) / F.nullif(raw, F.lit(0)), 3).alias("reduction"), *counts)


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed days, floored (not midnights crossed)."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / DAY_MICROS)


def previous_within(df: DataFrame, keys: list[str], ts: str, ident: str, days: int = GAP_DAYS) -> DataFrame:
    """ident and the previous row of the same keys, where at most `days` lie between."""
    w = Window.partitionBy(*keys).orderBy(ts, ident)
    seen = df.select(ident, ts, F.lag(ident).over(w).alias("previous"), F.lag(ts).over(w).alias("before"))
    return seen.where(F.col("previous").isNotNull() & (whole_days(F.col(ts), F.col("before")) <= days)).select(ident, "previous")


def reference_links(messages: DataFrame) -> DataFrame:
    """(id, other): messages (id, message_id, in_reply_to, references) and those that they answer."""
    asked = messages.select("id", F.explode(F.array_union(F.coalesce("references", F.array().cast("array<string>")), F.array("in_reply_to"))).alias("ref")).where(F.col("ref").isNotNull())
    known = messages.select(F.col("message_id").alias("ref"), F.col("id").alias("other"))
    return asked.join(known, "ref").where("id <> other").select("id", "other").distinct()


def overlap_links(messages: DataFrame, days: int = GAP_DAYS, chars: int = PROBE_CHARS, shingle: int = 5) -> DataFrame:
    """(id, other): for each quoted span of at least `chars` characters, the earliest message, at most `days` before, whose body
    holds the span's first `chars`. Spans and bodies are compared lower-cased and with white space collapsed.

    messages: id, ts, spans (array of quoted texts; null or empty where a header links the message already), body. Candidates
    share a run of the probe's inner words, an equi-join; a probe of few, long words shares the begin of its longest
    word with a word of the body instead. Containment is verified on candidates only.
    """
    long_word = -(-(chars - shingle - 1) // (shingle + 2))  # a probe of at most shingle + 1 words has one as long
    gram = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)])
    spans = messages.select("id", "ts", F.explode("spans").alias("span")).withColumn("span", F.lower(X.collapsed("span"))).where(F.length("span") >= chars)
    probes = spans.select("id", "ts", F.substring("span", 1, chars).alias("probe")).distinct().withColumn("w", F.split("probe", " "))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    key = F.when(F.size("w") >= shingle + 2, gram(F.col("w"), F.lit(1))).otherwise(F.xxhash64(F.lit("long"), F.substring(longest, 1, long_word)))
    bodies = materialise(messages.select(F.col("id").alias("other"), F.col("ts").alias("other_ts"), F.lower(X.collapsed(F.coalesce("body", F.lit("")))).alias("body")), "bodies")
    w = F.col("w")  # a column of its own: inside a lambda the text would be split again for every word
    grams = F.when(F.size(w) >= shingle, F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: gram(w, i)))
    parts = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - long_word + 1), lambda k: F.xxhash64(F.lit("long"), F.substring(x, k, F.lit(long_word))))
    pieces = F.flatten(F.transform(F.filter(w, lambda x: F.length(x) >= long_word), parts))
    placed = bodies.withColumn("w", F.split("body", " ")).select("other", "other_ts", F.explode(F.array_distinct(F.concat(F.coalesce(grams, F.array().cast("array<bigint>")), pieces))).alias("key"))
    near = (F.col("other_ts") < F.col("ts")) & (whole_days(F.col("ts"), F.col("other_ts")) <= days)
    met = probes.select("id", "ts", "probe", key.alias("key")).join(placed, "key").where(near).select("id", "probe", "other", "other_ts").distinct()
    held = met.join(bodies.select("other", "body"), "other").where(F.contains("body", F.col("probe")))
    return held.groupBy("id", "probe").agg(F.min(F.struct("other_ts", "other")).alias("first")).select("id", F.col("first.other").alias("other")).distinct()


def build_threads(messages: DataFrame, days: int = GAP_DAYS) -> DataFrame:
    """thread (t0000 by earliest message), id, index (from 1): components over references, quoted passages and equal subjects
    that follow within `days`.

    messages: id, message_id, ts, in_reply_to, references, subject, spans, body. An undated message stands before all dated
    ones; quoted passages only link messages without in_reply_to.
    """
    dated = messages.withColumn("ts", F.coalesce(F.col("ts").cast("timestamp"), F.to_timestamp(F.lit("0001-01-01")))).withColumn("subject", X.subject_key("subject"))
    quoting = dated.select("id", "ts", "body", F.when(F.col("in_reply_to").isNull(), F.col("spans")).alias("spans"))
    edges = reference_links(messages).unionByName(overlap_links(quoting, days))
    edges = edges.unionByName(previous_within(dated.where("subject <> ''"), ["subject"], "ts", "id", days).withColumnRenamed("previous", "other"))
    members = threads(dated.select("id"), edges).join(dated.select("id", "ts"), "id")
    numbered = numbered_threads(members)
    return numbered.select(F.concat(F.lit("t"), F.when(F.col("thread_no") < 10_000, F.lpad(F.col("thread_no").cast("string"), 4, "0")).otherwise(F.col("thread_no").cast("string"))).alias("thread"), "id", "index")


def threads(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id -> thread: the least id that links lead to; messages without links are threads of their own. ids are longs."""
    linked = components(edges.select(F.col("id").alias("a"), F.col("other").alias("b")))
    return nodes.join(linked, nodes["id"] == linked["node"], "left").select("id", F.coalesce("least", "id").alias("thread"))


def numbered_threads(members: DataFrame) -> DataFrame:
    """Adds thread_no by earliest message (undated first) and the member's 1-based index. members: thread, id, ts."""
    first = members.groupBy("thread").agg(F.min(F.struct(F.col("ts").isNotNull(), "ts", "id")).alias("first"))
    numbers = global_rank(first, "n", "first", "thread").select("thread", (F.col("n") - 1).alias("thread_no"))
    w = Window.partitionBy("thread").orderBy(F.asc_nulls_first("ts"), "id")
    return members.join(numbers, "thread").withColumn("index", F.row_number().over(w))


def value_histogram(df: DataFrame, column: Column, name: str, blank: str = "(blank)") -> DataFrame:
    """How many rows each value has; null and empty count as blank."""
    return df.groupBy(F.coalesce(F.nullif(column, F.lit("")), F.lit(blank)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def thread_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Adds thread to rows (id, ...): the one that the message belongs to, empty where it belongs to none. members: thread, id."""
    return rows.join(members.select("id", "thread"), "id", "left").withColumn("thread", F.coalesce("thread", F.lit("")))


def sections(paragraphs: DataFrame, doc: str, pos: str, heading: Column) -> DataFrame:
    """Adds section: how many headings stand at or before the paragraph (0: preamble)."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn("section", F.sum(heading.cast("int")).over(w))


def heading_path(paragraphs: DataFrame, doc: str, pos: str, level: str, heading: str, depth: int = 3) -> DataFrame:
    """Adds path: the open headings, outermost first; a heading closes those as deep or deeper. level is null for plain text."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col(level) == k, F.struct(F.col(pos).alias("p"), F.col(heading).alias("h"))), True).over(w) for k in range(1, depth + 1)}
    out = paragraphs
    for k, c in last.items():
        out = out.withColumn(f"__l{k}", c)
    open_at = []
    for k in range(1, depth + 1):
        shallower = [F.coalesce(F.col(f"__l{j}.p"), F.lit(-1)) for j in range(1, k)]
        own = F.col(f"__l{k}.p")
        alive = own.isNotNull()
        for s in shallower:
            alive = alive & (own > s)
        open_at.append(F.when(alive, F.col(f"__l{k}.h")))
    return out.withColumn("path", F.array_compact(F.array(*open_at))).drop(*[f"__l{k}" for k in last])


def quote_runs(rows: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """(doc, start, end): maximal runs of quoted lines; blank lines neither end a run nor count."""
    full = rows.where(F.trim(line) != "")
    w = Window.partitionBy(doc).orderBy(pos)
    flagged = full.withColumn("q", X.is_quoted(line)).withColumn("new", (F.col("q") & ~F.coalesce(F.lag("q").over(w), F.lit(False))).cast("int"))
    return flagged.withColumn("run", F.sum("new").over(w)).where("q").groupBy(doc, "run").agg(F.min(pos).alias("start"), F.max(pos).alias("end")).drop("run")


def issue_index(mentions: DataFrame) -> DataFrame:
    """issue, thread_count, mentions, first_mention, last_mention, threads from (issue, thread, date): two levels of counts."""
    by_thread = mentions.groupBy("issue", "thread").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    thread = F.struct(F.col("first").alias("first_mention"), "thread", F.col("last").alias("last_mention"), F.col("n").alias("mentions"))
    return by_thread.groupBy("issue").agg(F.count(F.lit(1)).alias("thread_count"), F.sum("n").alias("mentions"), F.min("first").alias("first_mention"), F.max("last").alias("last_mention"), F.array_sort(F.collect_list(thread)).alias("threads"))


def majority(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent value; the least one on ties."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("value"))).alias("best"))
    return best.select(group, F.col("best.value").alias(value), (-F.col("best.m")).alias("n"))


def preferred(df: DataFrame, key: Column, preference: Column, tie: str) -> DataFrame:
    """One row per key: the best preference (least), then the least tie."""
    w = Window.partitionBy("__key").orderBy(preference, tie)
    return df.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__key")
