"""Corpus queries: text forms, deduplication, furniture, sessions, threads, issues, sections, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators.worktables import global_rank
from .common import query, sql_values, table, values

SUBJECT = "concat(CASE event_id % 4 WHEN 0 THEN 'Re: ' WHEN 1 THEN 'FWD: re : ' WHEN 2 THEN ' [LIST] Aw: ' ELSE '' END, event_type, '  Issue ', user_id, CASE WHEN event_id % 3 = 0 THEN ' (was: old\nthing)' ELSE '' END)"


@query(rf"SELECT event_id, lower(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace({SUBJECT}, '\[list\]\s*', '', 'gi'), '\(was:.*?\)', '', 'gis')), '^\s*((re|fwd|aw|fw|sv|vs|antw)\s*:\s*)+', '', 'i'), '\s+', ' ', 'g'))) AS subject FROM events")
def x7_normalize_subject(spark, sf):
    return table(spark, sf, "events").select("event_id", X.subject_key(F.expr(SUBJECT.replace("\n", "\\n"))).alias("subject"))


@query("SELECT doc_id, left(sha1(text), 16) AS id FROM documents")
def x8_hash_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.hash_id("text").alias("id"))


MENTION = "concat('about E', event_id % 100, '.1 and P', user_id, 'i; (E', event_id % 7, ') xE9 P1234 E', event_id % 3, 'x')"


@query(rf"SELECT event_id, array_to_string(list_sort(list_distinct(regexp_extract_all({MENTION}, '\b([EP]\d{{1,3}})(?:\.\d)?i?\b', 1))), ',') AS ids FROM events")
def x9_entities(spark, sf):
    return table(spark, sf, "events").select("event_id", F.array_join(X.identifiers(F.expr(MENTION)), ",").alias("ids"))


@query(rf"WITH m AS (SELECT event_id, list_sort(list_distinct(regexp_extract_all({MENTION}, '\b([EP]\d{{1,3}})(?:\.\d)?i?\b', 1))) AS ids FROM events), k AS (SELECT list(DISTINCT concat('E', p_size)) AS known FROM part) SELECT event_id, array_to_string(list_filter(ids, lambda x: list_contains(known, x)), ',') AS current, array_to_string(list_filter(ids, lambda x: NOT list_contains(known, x)), ',') AS historical FROM m, k")
def x9_known_and_former(spark, sf):
    """Identifiers of the model (here: sizes of parts) and others."""
    known = table(spark, sf, "part").select(F.concat(F.lit("E"), F.col("p_size")).alias("id")).agg(F.collect_set("id").alias("known"))  # one row, as many ids as the model has
    found = table(spark, sf, "events").select("event_id", X.identifiers(F.expr(MENTION)).alias("ids")).crossJoin(F.broadcast(known))
    split = found.select("event_id", X.known_and_former(F.col("ids"), F.col("known")).alias("s"))
    return split.select("event_id", F.array_join("s.current", ",").alias("current"), F.array_join("s.historical", ",").alias("historical"))


ISSUES = "concat('Issue ', event_id % 100, ', 3rd draft; issues:', user_id, ' issue ', event_id % 30, 'th; Loom Digest, Vol 5, Issue 7; issue9_5 ISSUE #', event_id % 12345)"


@query(rf"""WITH m AS (SELECT event_id, unnest(regexp_extract_all(regexp_replace({ISSUES}, '\bdigest,?\s*vol\.?\s*\d+,?\s*issue\s*\d+', ' ', 'gi'), '(?i)\bissues?(?:[ \t]+[:#]?[ \t]*|[:#][ \t]*)(\d+(?:\s*[a-z]+)?)', 1)) AS hit FROM events),
    n AS (SELECT event_id, regexp_extract(hit, '\d+') AS digits, hit FROM m WHERE NOT regexp_matches(hit, '(?i)^\d+\s*(st|nd|rd|th)$'))
    SELECT event_id, array_to_string(list_sort(list(DISTINCT digits::INT)), ',') AS issues FROM n WHERE length(digits) <= 4 GROUP BY 1""")
def x12_issue_numbers(spark, sf):
    found = table(spark, sf, "events").select("event_id", X.issue_numbers(F.expr(ISSUES)).alias("n")).where(F.size("n") > 0)
    return found.select("event_id", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("issues"))


SQL_MATCH = r"trim(regexp_replace(regexp_replace(translate({}, '‘’‚′“”„″', '''''''''\"\"\"\"'), '\s+', ' ', 'g'), '\s+([.,;:?!])', '\1', 'g'))".replace('\\"', '"')


@query(f"SELECT doc_id, md5({SQL_MATCH.format('text')}) AS form FROM documents")
def x17_normalize_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.match_form("text")).alias("form"))


@query(rf"SELECT doc_id, md5(lower({SQL_MATCH.format(chr(39).join(['regexp_replace(concat(', '> | ', ', text), ', '(?m)^[ \\t]*(?:[>|][ \\t]*)+', ', ', '', ', ', 'g', ')']))})) AS key FROM documents")
def x21_match_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.paragraph_key(F.concat(F.lit("> | "), "text"))).alias("key"))


@query("SELECT doc_id, sha256(left(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), 4000)) AS key FROM documents")
def x32_content_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_key("text").alias("key"))


@query(r"SELECT page_id, regexp_extract(url, '([^/#]+)/?$', 1) AS name, regexp_extract(url, '^(.*[/#])[^/#]*$', 1) AS namespace, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM pages")
def x27_x28_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.local_name("url").alias("name"), X.namespace_of("url").alias("namespace"), X.label_key("url").alias("key"))


HEADS = [(1, "ISSUE 345: something"), (2, "issue:161 how"), (3, "Issue 172, 173 & 174"), (4, "204: done"), (5, "no issue 5"), (6, "issues # 1/2/3 and 4,5,6,7,8,9"), (7, "7) agreed"), (8, "9999: not registered"), (9, "12 people")]


@query(rf"""WITH h AS (SELECT id, list_transform(regexp_extract_all(regexp_extract(t, '(?i)^\s*issues?\s*[:#]?\s*((?:\d{{1,4}})(?:\s*(?:,|&|and|/)\s*\d{{1,4}})*)', 1), '\d{{1,4}}')[1:8], lambda x: x::INT) AS named, TRY_CAST(regexp_extract(t, '^\s*(\d{{1,4}})\s*[:.)]\s*\S', 1) AS INT) AS bare FROM {sql_values(HEADS, 'id', 't')})
    SELECT id, array_to_string(CASE WHEN len(named) > 0 THEN named WHEN bare IN (SELECT p_partkey FROM part) THEN [bare] ELSE [] END, ',') AS issues FROM h""")
def x13_heading_issues(spark, sf):
    """A bare number heads an issue only where the register (here: parts) knows it."""
    register = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("bare"), F.lit(True).alias("registered"))
    heads = values(spark, "id int, t string", HEADS).withColumn("bare", X.bare_number("t")).join(register, "bare", "left")
    found = X.heading_issues("t", F.coalesce("registered", F.lit(False)))
    return heads.select("id", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("issues"))


DATES = [(1, "15/1/2018"), (2, "9/10/2017"), (3, "27 - 30 November, 2018"), (4, "9-10th December 2004"), (5, "1st of May 09, 2009"), (6, "December 2004"), (7, None), (8, "undated"), (9, "18 2018"), (10, "15.09.2008")]


@query(rf"""WITH d AS (SELECT id, coalesce(t, '') AS t FROM {sql_values(DATES, 'id', 't')}), p AS (SELECT id, t, regexp_extract(t, '\b(\d{{1,2}})[/.](\d{{1,2}})[/.]((?:19|20)\d{{2}})\b', ['d', 'm', 'y']) AS n, regexp_extract(t, '\b(19[89]\d|20[0-5]\d)\b', 1) AS y,
    list_filter(list_transform(regexp_extract_all(t, '\b(\d{{1,2}})(?:st|nd|rd|th)?\b', 1), lambda x: x::INT), lambda x: x BETWEEN 1 AND 31) AS days FROM d),
    k AS (SELECT id, CASE WHEN n.y <> '' THEN [0, TRY_CAST(n.y AS INT), TRY_CAST(n.m AS INT), TRY_CAST(n.d AS INT)] WHEN y = '' THEN [1, 9999, 99, 99] ELSE [0, TRY_CAST(y AS INT),
    coalesce(list_position(list_transform(['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december'], lambda m: contains(lower(t), m)), true), 99),
    coalesce(list_filter(days, lambda x: x <> TRY_CAST(y AS INT) % 100)[1], 99)] END AS k FROM p) SELECT id, k[1] AS undated, k[2] AS year, k[3] AS month, k[4] AS day, row_number() OVER (ORDER BY k, id) AS place FROM k""")
def t10_meeting_key(spark, sf):
    keyed = values(spark, "id int, t string", DATES).select("id", X.meeting_key("t").alias("k"))
    return keyed.select("id", "k.*", F.row_number().over(Window.orderBy("k", "id")).alias("place"))


@query("SELECT doc_id, first_value(doc_id) OVER w AS first_id, doc_id <> first_value(doc_id) OVER w AS is_duplicate FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id)")
def c13_first_wins_dedup(spark, sf):
    return C.first_wins(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "first_id", "is_duplicate")


@query("""WITH d AS (SELECT length(text) AS n, doc_id <> min(doc_id) OVER (PARTITION BY text) AS dup FROM documents)
    SELECT count(*) AS messages, count_if(dup) AS duplicates, sum(n) AS raw_chars, sum(n) FILTER (NOT dup) AS clean_chars, round(100.0 * (sum(n) - sum(n) FILTER (NOT dup)) / sum(n), 3) AS reduction FROM d""")
def a1_clean_stats(spark, sf):
    d = C.first_wins(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select(F.length("text").alias("n"), "is_duplicate")
    kept = F.sum(F.when(~F.col("is_duplicate"), F.col("n")))
    return d.agg(F.count(F.lit(1)).alias("messages"), F.count_if("is_duplicate").alias("duplicates"), F.sum("n").alias("raw_chars"), kept.alias("clean_chars"), F.round(100.0 * (F.sum("n") - kept) / F.sum("n"), 3).alias("reduction"))


@query("SELECT md5(text) AS key, array_to_string(list_sort(list(doc_id)), ',') AS members FROM documents GROUP BY text HAVING count(*) > 1")
def a15_duplicate_groups(spark, sf):
    groups = C.duplicate_groups(table(spark, sf, "documents"), F.md5("text"), "doc_id")
    return groups.select("key", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


PARAGRAPHS = rf"p AS (SELECT doc_id, pos - 1 AS pos, line, lower({SQL_MATCH.format('line')}) AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(line) <> ''), f AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM p)"


def _paragraphs(spark, sf):
    own = C.lines(table(spark, sf, "documents"), "text", "doc_id").where(F.trim("line") != "")
    return C.repeated_paragraphs(own, "doc_id", "line")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, pos, md5(line) AS line FROM f WHERE NOT dropped")
def j7_paragraph_dedup(spark, sf):
    return _paragraphs(spark, sf).where("NOT dropped").select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("line").alias("line"))


@query(f"WITH {PARAGRAPHS} SELECT lang, count_if(NOT dropped) AS kept, count_if(dropped) AS removed, sum(CASE WHEN dropped THEN 0 ELSE length(line) END) AS kept_chars, sum(CASE WHEN dropped THEN length(line) ELSE 0 END) AS removed_chars FROM f JOIN documents USING (doc_id) GROUP BY lang")
def a8_dedup_chars(spark, sf):
    size = lambda flag: F.sum(F.when(flag, F.length("line")).otherwise(0))
    own = _paragraphs(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return own.groupBy("lang").agg(F.count_if(~F.col("dropped")).alias("kept"), F.count_if("dropped").alias("removed"), size(~F.col("dropped")).alias("kept_chars"), size(F.col("dropped")).alias("removed_chars"))


@query(r"""WITH l AS (SELECT DISTINCT source, doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM documents), c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' AND length(line) < 90 GROUP BY ALL),
    s AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1 HAVING count(*) >= 3) SELECT source, line, n FROM c JOIN s USING (source) WHERE n > pages * 0.04""")
def a16_page_furniture(spark, sf):
    return C.furniture(table(spark, sf, "documents"), "source", "doc_id", "text", share=0.04)


GAPPED = "g AS (SELECT event_id, ts, lag(event_id) OVER w AS previous, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id))"


@query(f"WITH {GAPPED} SELECT event_id, previous FROM g WHERE previous IS NOT NULL AND floor(date_diff('microsecond', before, ts) / 86400000000) <= 1")
def w3_subject_gap(spark, sf):
    return C.previous_within(table(spark, sf, "events"), ["event_type", "user_id"], "ts", "event_id", days=1)


@query(f"""WITH {GAPPED}, n AS (SELECT g.event_id, e.event_type, e.user_id, g.ts, CASE WHEN previous IS NULL OR floor(date_diff('microsecond', before, g.ts) / 86400000000) > 1 THEN 1 ELSE 0 END AS starts FROM g JOIN events e USING (event_id)),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS island FROM n) SELECT event_id AS id, min(event_id) OVER (PARTITION BY event_type, user_id, island) AS thread FROM s""")
def h1_components(spark, sf):
    """Threads as connected components of session links: the SQL twin finds the same sets as islands."""
    events = table(spark, sf, "events")
    edges = C.previous_within(events, ["event_type", "user_id"], "ts", "event_id", days=1).select(F.col("event_id").alias("id"), F.col("previous").alias("other"))
    return C.threads(events.select(F.col("event_id").alias("id")), edges)


@query("""WITH t AS (SELECT user_id, min({'t': ts, 'i': event_id}) AS f FROM events GROUP BY 1), n AS (SELECT user_id, row_number() OVER (ORDER BY f, user_id) - 1 AS thread_no FROM t)
    SELECT event_id AS id, thread_no, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS index FROM events JOIN n USING (user_id)""")
def w4_thread_rank(spark, sf):
    members = table(spark, sf, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("id"), "ts")
    return C.numbered_threads(members).select("id", "thread_no", "index")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS index FROM conversations")
def w5_message_index(spark, sf):
    grouped = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.posexplode("turns").alias("i", "turn")).select("conv_id", "turn", (F.col("i") + 1).alias("index"))


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) >= 5")
def f5_eligible_threads(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("WITH s AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id) SELECT count(*) AS threads, count_if(n = 1) AS singletons, count_if(n > 1) AS multi, max(n) AS largest FROM s")
def a2_thread_stats(spark, sf):
    sizes = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("threads"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("largest"))


TURNS = r"""m AS (SELECT conv_id * 1000 + turn AS id, TIMESTAMP '2024-01-01' + to_hours((conv_id * 7 + turn)::INT) AS ts, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS body,
    CASE WHEN turn > 0 THEN [replace(substr(lag(text) OVER w, 10, 300), ' ', chr(10)), substr(lag(text, 2) OVER w, 3)] END AS spans FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _turns(spark, sf):
    """Each turn quotes two earlier ones, the last one with every space a line break."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    hours = (F.col("conv_id") * 7 + F.col("turn")).cast("long")  # seconds since 1970 outgrow an int
    spans = F.array(F.replace(F.substring(F.lag("text").over(w), 10, 300), F.lit(" "), F.lit("\n")), F.expr("substr(lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn), 3)"))
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", F.timestamp_seconds(F.lit(1_704_067_200) + hours * 3600).alias("ts"), F.col("text").alias("body"), F.when(F.col("turn") > 0, spans).alias("spans"))


OVERLAP = rf"""{TURNS}, p AS (SELECT DISTINCT id, ts, left(span, 200) AS probe FROM (SELECT id, ts, lower(trim(regexp_replace(unnest(spans), '\s+', ' ', 'g'))) AS span FROM m WHERE spans IS NOT NULL) WHERE length(span) >= 200),
    o AS (SELECT DISTINCT id, other FROM (SELECT p.id, probe, arg_min(o.id, {{'t': o.ts, 'i': o.id}}) AS other FROM p JOIN m o ON o.ts < p.ts AND floor(date_diff('microsecond', o.ts, p.ts) / 86400000000) <= 30 AND contains(o.body, p.probe) GROUP BY ALL))"""


@query(f"WITH {OVERLAP} SELECT id, other FROM o")
def j3_overlap_link(spark, sf):
    return C.overlap_links(_turns(spark, sf))


THREADED = f"""WITH RECURSIVE {OVERLAP}, c AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, TIMESTAMP '2024-01-01' + to_hours((conv_id * 7 + turn)::INT) AS ts FROM conversations),
    s AS (SELECT id, lag(id) OVER (PARTITION BY conv_id % 40 ORDER BY ts, id) AS other, ts, lag(ts) OVER (PARTITION BY conv_id % 40 ORDER BY ts, id) AS before FROM c WHERE turn % 4 = 0),
    e AS (SELECT id, other FROM o WHERE id % 3 <> 0 UNION SELECT id, id - 1 FROM c WHERE turn > 0 AND id % 3 = 0 UNION SELECT id, other FROM s WHERE other IS NOT NULL AND floor(date_diff('microsecond', before, ts) / 86400000000) <= 30),
    b AS (SELECT id, other FROM e UNION SELECT other, id FROM e), r(id, other) AS (SELECT id, id FROM c UNION SELECT r.id, b.other FROM r JOIN b ON b.id = r.other), l AS (SELECT id, min(other) AS root FROM r GROUP BY id),
    t AS (SELECT root, row_number() OVER (ORDER BY min(ts), min(root)) - 1 AS n FROM l JOIN c USING (id) GROUP BY root)"""


@query(f"{THREADED} SELECT concat('t', lpad(n::VARCHAR, 4, '0')) AS thread, id, row_number() OVER (PARTITION BY root ORDER BY ts, id) AS index FROM l JOIN t USING (root) JOIN c USING (id)")
def h1_build_threads(spark, sf):
    """Whole threads over the three kinds of links: headers, quoted passages, and equal subjects within 30 days."""
    ident = lambda d: F.concat(F.lit("<"), (F.col("id") - d).cast("string"), F.lit(">"))
    answers = (F.col("turn") > 0) & (F.col("id") % 3 == 0)
    subject = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Re: talk "), (F.col("conv_id") % 40).cast("string")))
    own = _turns(spark, sf).select("id", "ts", "body", "spans", ident(0).alias("message_id"), F.when(answers, ident(1)).alias("in_reply_to"), F.array().cast("array<string>").alias("references"), subject.alias("subject"))
    return C.build_threads(own)


@query("SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + turn - 1 AS other FROM conversations WHERE turn > 0")
def j2_reference_links(spark, sf):
    ident = lambda d: F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("."), (F.col("turn") - d).cast("string"), F.lit(">"))
    own = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), ident(0).alias("message_id"), F.when(F.col("turn") > 0, ident(1)).alias("in_reply_to"), F.array(F.lit("<gone>")).alias("references"))
    return C.reference_links(own)


MENTIONED = "m AS (SELECT json_extract_string(props, '$.k')::INT AS issue, user_id AS thread, strftime(ts, '%Y-%m-%d') AS date FROM events)"


@query(f"WITH {MENTIONED}, t AS (SELECT issue, thread, count(*) AS n, min(date) AS a, max(date) AS z FROM m GROUP BY ALL) SELECT issue, count(*) AS thread_count, sum(n) AS mentions, min(a) AS first_mention, max(z) AS last_mention, md5(array_to_string(list(concat(a, ':', thread, ':', z, ':', n) ORDER BY a, thread), ',')) AS threads FROM t GROUP BY issue")
def a5_issue_index(spark, sf):
    index = C.issue_index(_mentions(spark, sf))
    flat = F.array_join(F.transform("threads", lambda t: F.concat_ws(":", t["first_mention"], t["thread"].cast("string"), t["last_mention"], t["mentions"].cast("string"))), ",")
    return index.select("issue", "thread_count", "mentions", "first_mention", "last_mention", F.md5(flat).alias("threads"))


def _mentions(spark, sf):
    return table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("int").alias("issue"), F.col("user_id").alias("thread"), F.date_format("ts", "yyyy-MM-dd").alias("date"))


@query("SELECT coalesce(nullif(CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END, ''), '(blank)') AS status, count(*) AS n FROM orders GROUP BY 1")
def a6_status_hist(spark, sf):
    status = F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("o_orderpriority"))
    return C.value_histogram(table(spark, sf, "orders"), status, "status")


@query(f"""WITH {MENTIONED}, d AS (SELECT issue, count(DISTINCT thread) AS threads FROM m GROUP BY 1), r AS (SELECT p_partkey AS issue, p_name AS title FROM part), p AS (SELECT page_id AS issue, length(html) AS chars FROM pages)
    SELECT issue, title, coalesce(threads, 0) AS threads, chars, title IS NOT NULL AS registered FROM d FULL JOIN r USING (issue) FULL JOIN p USING (issue)""")
def j5_issue_union(spark, sf):
    discussed = _mentions(spark, sf).groupBy("issue").agg(F.count_distinct("thread").alias("threads"))
    register = table(spark, sf, "part").select(F.col("p_partkey").alias("issue"), F.col("p_name").alias("title"))
    paged = table(spark, sf, "pages").select(F.col("page_id").alias("issue"), F.length("html").alias("chars"))
    every = discussed.join(register, "issue", "full_outer").join(paged, "issue", "full_outer")
    return every.select("issue", "title", F.coalesce("threads", F.lit(0)).alias("threads"), "chars", F.col("title").isNotNull().alias("registered"))


@query(f"WITH {MENTIONED} SELECT thread, issue, count(*) AS n FROM m WHERE issue IN (SELECT p_partkey FROM part WHERE p_size > 20) GROUP BY ALL")
def r1_issue_mentions(spark, sf):
    known = table(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").cast("int").alias("issue"))
    return _mentions(spark, sf).join(known, "issue", "left_semi").groupBy("thread", "issue").agg(F.count(F.lit(1)).alias("n"))


@query(rf"WITH m AS (SELECT event_id, unnest(regexp_extract_all({MENTION}, '\b([EP]\d{{1,3}})(?:\.\d)?i?\b', 1)) AS id FROM events) SELECT id, count(*) AS mentions, count(DISTINCT event_id) AS messages FROM m GROUP BY id")
def a3_a4_mentions(spark, sf):
    found = table(spark, sf, "events").select("event_id", F.explode(F.regexp_extract_all(F.expr(MENTION), F.lit(X.IDENTIFIER), F.lit(1))).alias("id"))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("event_id").alias("messages"))


@query("SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 11 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END, event_id) AS place FROM events WHERE list_contains([event_type, concat('u', user_id % 5)], 'u3')")
def j14_chronology(spark, sf):
    """Rows whose entities hold a concept, oldest first, undated ones before all."""
    rows = table(spark, sf, "events").select("event_id", F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))).alias("entities"), F.when(F.col("event_id") % 11 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"))
    held = rows.where(F.array_contains("entities", "u3")).select("event_id", F.coalesce("date", F.lit("")).alias("date"))
    return global_rank(held, "place", "date", "event_id").select("event_id", "place")


@query(rf"WITH d AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS e FROM documents) SELECT doc_id, len(e) AS concepts, row_number() OVER (ORDER BY len(e), doc_id) AS place FROM d WHERE list_contains(e, 'thention') ORDER BY 3 LIMIT 3")
def j13_narratives(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_distinct(X.tokens("text")).alias("e")).where(F.array_contains("e", "thention"))
    return d.select("doc_id", F.size("e").alias("concepts")).orderBy("concepts", "doc_id").limit(3).withColumn("place", F.row_number().over(Window.orderBy("concepts", "doc_id")))


LINED = "l AS (SELECT doc_id, pos - 1 AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"


@query(f"WITH {LINED}, s AS (SELECT *, sum(CASE WHEN length(line) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l) SELECT doc_id, section, count(*) AS n, min(pos) AS first_pos, sum(length(line)) AS chars FROM s GROUP BY ALL")
def w8_sections(spark, sf):
    own = C.sections(C.lines(table(spark, sf, "documents"), "text", "doc_id"), "doc_id", "pos", F.length("line") < 20)
    return own.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first_pos"), F.sum(F.length("line")).alias("chars"))


@query(f"WITH {LINED} SELECT doc_id, pos, concat('s', lpad((row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::VARCHAR, 4, '0')) AS chunk_id FROM l WHERE trim(line) <> ''")
def w7_chunk_ids(spark, sf):
    own = C.lines(table(spark, sf, "documents"), "text", "doc_id").where(F.trim("line") != "")
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("string")
    return own.select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("s"), F.lpad(number, 4, "0")).alias("chunk_id"))


LEVELS = [(1, 0, 1, "A"), (1, 1, 2, "A.1"), (1, 2, None, "text"), (1, 3, 3, "A.1.x"), (1, 4, 2, "A.2"), (1, 5, None, "text"), (1, 6, 1, "B"), (1, 7, 3, "B.?.y"), (1, 8, None, "text"), (2, 0, None, "text")]
SQL_OPEN = "(SELECT h FROM v b WHERE b.doc = a.doc AND b.level = {k} AND b.pos <= a.pos AND NOT EXISTS (SELECT 1 FROM v c WHERE c.doc = a.doc AND c.level < {k} AND c.pos > b.pos AND c.pos <= a.pos) ORDER BY b.pos DESC LIMIT 1)"


@query(f"WITH v AS (SELECT * FROM {sql_values(LEVELS, 'doc', 'pos', 'level', 'h')}) SELECT doc, pos, array_to_string(list_filter([{', '.join(SQL_OPEN.format(k=k) for k in (1, 2, 3))}], lambda x: x IS NOT NULL), ' > ') AS path FROM v a")
def w9_heading_path(spark, sf):
    own = C.heading_path(values(spark, "doc int, pos int, level int, h string", LEVELS), "doc", "pos", "level", "h")
    return own.select("doc", "pos", F.array_join("path", " > ").alias("path"))


@query(f"""WITH {LINED}, q AS (SELECT doc_id, pos, (pos + doc_id) % 5 IN (1, 2) AS q FROM l WHERE trim(line) <> ''), n AS (SELECT *, CASE WHEN q AND NOT coalesce(lag(q) OVER (PARTITION BY doc_id ORDER BY pos), false) THEN 1 ELSE 0 END AS new FROM q),
    r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n) SELECT doc_id, min(pos) AS "start", max(pos) AS "end" FROM r WHERE q GROUP BY doc_id, run""")
def w12_w13_quote_runs(spark, sf):
    own = C.lines(table(spark, sf, "documents"), "text", "doc_id")
    marked = own.withColumn("line", F.when(((F.col("pos") + F.col("doc_id")) % 5).isin(1, 2) & (F.trim("line") != ""), F.concat(F.lit("> "), "line")).otherwise(F.regexp_replace("line", r"^\s*[>|]", "")))
    return C.quote_runs(marked, "doc_id", "pos", "line").select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


HOST = r"regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@query(f"SELECT stem, page_id FROM (SELECT {HOST} AS stem, page_id, row_number() OVER (PARTITION BY {HOST} ORDER BY CASE WHEN url LIKE '%?%' THEN 2 WHEN url LIKE '%#%' THEN 1 ELSE 0 END, page_id) AS n FROM pages) WHERE n = 1")
def s24_format_preference(spark, sf):
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    rank = F.when(F.contains("url", F.lit("?")), 2).when(F.contains("url", F.lit("#")), 1).otherwise(0)
    return C.preferred(table(spark, sf, "pages"), host, rank, "page_id").select(host.alias("stem"), "page_id")


@query(f"WITH c AS (SELECT page_id % 7 AS grp, {HOST} AS ns, count(*) AS n FROM pages GROUP BY ALL) SELECT grp, ns, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, ns) AS r FROM c) WHERE r = 1")
def a10_majority_namespace(spark, sf):
    own = table(spark, sf, "pages").select((F.col("page_id") % 7).alias("grp"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("ns"))
    return C.majority(own, "grp", "ns")


@query("""SELECT 'union' AS op, count(*) AS n, sum(k) AS total FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier) UNION ALL SELECT 'intersect', count(*), sum(k) FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except', count(*), sum(k) FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier)""")
def u_set_ops(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    keys, other = c.select(F.col("c_custkey").alias("k")), s.select(F.col("s_suppkey").alias("k"))
    of = lambda name, d: d.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))
    nations = c.select(F.col("c_nationkey").cast("long").alias("k")).intersect(s.select(F.col("s_nationkey").cast("long").alias("k")))
    return of("union", keys.union(other).distinct()).unionByName(of("intersect", nations)).unionByName(of("except", keys.exceptAll(other).distinct()))
