"""Quotations, cleaning, chunks, HTML and mail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as K
from ..functions import cleaning as L
from ..functions import mail as M
from ..functions import text as X
from ..operators import quotes as Q
from .common import query, sql_values, table, values
from .corpus import SQL_MATCH

HITS = f"""t AS (SELECT doc_id AS text_id, {SQL_MATCH.format('text')} AS t FROM documents), p AS (SELECT item_id AS phrase_id, lower({SQL_MATCH.format('text')}) AS p FROM benchmark UNION ALL SELECT 1000, 'thinor' UNION ALL SELECT 1001, 'the and attion to'),
    h AS (SELECT phrase_id, text_id, strpos(lower(t), p) AS start, p, t FROM p, t WHERE contains(lower(t), p)),
    c AS (SELECT *, start + length(p) AS z, greatest(1, start - 60) AS low, least(length(t) + 1, start + length(p) + 60) AS high FROM h)"""


def _hits(spark, sf):
    phrases = table(spark, sf, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase")).unionByName(values(spark, "phrase_id long, phrase string", [(1000, "thinor"), (1001, "the and attion to")]))
    return Q.contained(phrases, table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text"))


@query(f"WITH {HITS} SELECT phrase_id, text_id, start, concat(CASE WHEN low > 1 THEN '…' ELSE '' END, substr(t, low, start - low), '**', substr(t, start, z - start), '**', substr(t, z, high - z), CASE WHEN high <= length(t) THEN '…' ELSE '' END) AS context FROM c")
def x19_find_quote(spark, sf):
    return _hits(spark, sf)


@query(f"WITH {HITS} SELECT phrase_id, min(text_id) AS text_id FROM h GROUP BY phrase_id")
def i12_first_source(spark, sf):
    return Q.first_hits(_hits(spark, sf), "text_id").select("phrase_id", "text_id")


@query(f"WITH {HITS} SELECT p.phrase_id, CASE WHEN bool_or(h.text_id IS NOT NULL) THEN 'literal' WHEN max(length(p.p)) < 25 THEN 'short' ELSE 'absent' END AS verdict, count(h.text_id) AS n FROM p LEFT JOIN h USING (phrase_id) GROUP BY 1")
def i13_containment(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("phrase_id"), F.length(X.match_form("text")).alias("size")).unionByName(values(spark, "phrase_id long, size int", [(1000, 6), (1001, 17)]))
    n = _hits(spark, sf).groupBy("phrase_id").agg(F.count(F.lit(1)).alias("n"))
    verdict = F.when(F.col("n").isNotNull(), "literal").when(F.col("size") < Q.PARTIAL_CHARS, "short").otherwise("absent")
    return asked.join(n, "phrase_id", "left").select("phrase_id", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("n"))


@query(rf"""WITH d AS (SELECT doc_id, lower({SQL_MATCH.format('text')}) AS t FROM documents), w AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM d), f AS (SELECT doc_id, t, array_to_string(w[2:6], ' ') AS a, array_to_string(w[12:16], ' ') AS b FROM w WHERE len(w) >= 20),
    o AS (SELECT doc_id, t, CASE WHEN doc_id % 2 = 0 THEN a ELSE b END AS a, CASE WHEN doc_id % 2 = 0 THEN b ELSE a END AS b FROM f), s AS (SELECT *, strpos(t, a) AS s, strpos(substr(t, strpos(t, a) + length(a)), b) AS r FROM o)
    SELECT doc_id, CASE WHEN s > 0 AND r > 0 THEN s END AS "start", CASE WHEN s > 0 AND r > 0 THEN s + length(a) + r - 1 + length(b) END AS "end" FROM s""")
def x18_elided(spark, sf):
    """Two passages joined by an ellipsis: found in their order, not in the other."""
    d = table(spark, sf, "documents").select("doc_id", F.lower(X.match_form("text")).alias("t")).withColumn("w", F.split("t", " ")).where(F.size("w") >= 20)
    part = lambda at: F.array_join(F.slice("w", at, 5), " ")
    phrase = F.when(F.col("doc_id") % 2 == 0, F.concat(part(2), F.lit(" ... "), part(12))).otherwise(F.concat(part(12), F.lit(" [cut] "), part(2)))
    found = d.select("doc_id", Q.elided_span(F.col("t"), phrase).alias("s"))
    return found.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query()
def x20_closest(spark, sf):
    """How much of each benchmark passage each of its candidate documents holds as one run (tested against difflib)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return Q.candidates(docs, items).join(docs, "doc_id").join(items, "item_id").select("doc_id", "item_id", Q.closest_udf("text", "phrase").alias("score"))


MAIL = "concat(text, chr(10), '-- ', chr(10), 'sent from afar')"


@query("WITH m AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations) SELECT conv_id, turn, 1 AS signatures, trim(array_to_string(l, chr(10)), concat(chr(10), ' ')) = trim(array_to_string(l, chr(10)), concat(chr(10), ' ')) AS same FROM m")
def c1_strip(spark, sf):
    """A signature and what follows it go; the text before stays as it was."""
    own = table(spark, sf, "conversations").withColumn("mail", F.concat("text", F.lit("\n-- \nsent from afar")))
    cleaned = own.select("conv_id", "turn", "text", L.clean_body_udf("mailing list")("mail").alias("c"))
    same = F.trim(F.regexp_replace("c.body", r"^\s+|\s+$", "")) == F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    return cleaned.select("conv_id", "turn", F.col("c.stripped")["signature"].alias("signatures"), same.alias("same"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END AS single_block, CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS spans FROM conversations")
def c9_quote_rules(spark, sf):
    """Two quoted blocks stay and are marked; a single one is taken out."""
    long = F.concat(F.lit("my answer, "), F.repeat(F.lit("word "), 60))
    two = F.concat(F.lit("> first\n"), long, F.lit("\n> second\nmore"))
    one = F.concat(F.lit("A. Person wrote:\n> only\n> this\n"), long)
    own = table(spark, sf, "conversations").withColumn("mail", F.when(F.col("turn") % 2 == 0, two).otherwise(one))
    cleaned = own.select("conv_id", "turn", L.clean_body_udf("mailing list")("mail").alias("c"))
    return cleaned.select("conv_id", "turn", F.col("c.stripped")["single_block_quote"].alias("single_block"), F.size("c.quote_spans").alias("spans"))


@query("SELECT doc_id, true AS bounded, true AS contained, CASE WHEN length(text) <= 2000 OR length(regexp_replace(text, '\\s+', '', 'g')) > 2000 THEN length(regexp_replace(text, '\\s+', '', 'g')) <= 2000 END AS single FROM documents")
def h3_chunks(spark, sf):
    """Chunks are within the size and occur in the text; one at most where the text fits (null where white space decides)."""
    own = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "text", K.recursive_split_udf("text").alias("c"))
    clear = (F.length("text") <= 2000) | (F.length(F.regexp_replace("text", r"\s+", "")) > 2000)
    return own.select("doc_id", F.forall("c", lambda x: F.length(x) <= 2000).alias("bounded"), F.forall("c", lambda x: F.contains(F.col("t"), x)).alias("contained"), F.when(clear, F.size("c") <= 1).alias("single"))


@query("SELECT doc_id, true AS bounded, length(regexp_replace(text, '\\s+', '', 'g')) AS chars FROM documents")
def h6_sentence_pack(spark, sf):
    """Packed sentences are within the limit and lose no character but white space."""
    own = table(spark, sf, "documents").select("doc_id", K.sentence_pack_udf("text").alias("c"))
    return own.select("doc_id", F.forall("c", lambda x: F.length(x) <= 6000).alias("bounded"), F.length(F.regexp_replace(F.array_join("c", ""), r"\s+", "")).alias("chars"))


@query()
def w11_pack_shards(spark, sf):
    """Threads in shards of at most 100,000 characters and ten threads (tested on its rules)."""
    sizes = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars")).withColumn("part", F.col("conv_id") % 4)
    return K.shard_numbers(sizes, "part", "conv_id", "chars")


#: Pages as plain text by patterns: heads and comments go, block tags break lines, cells are parted, other tags go, entities are resolved.
PLAIN = r"""regexp_replace(html, '(?is)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"""
PLAIN = rf"regexp_replace(regexp_replace(regexp_replace({PLAIN}, '(?i)<(p|br|div|tr|li)(\s[^>]*)?/?>', chr(10), 'g'), '(?i)<(td|th)(\s[^>]*)?>', ' ', 'g'), '<[^>]+>', '', 'g')"
PLAIN = f"replace(replace(replace(replace(replace(replace({PLAIN}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
PLAIN = rf"trim(regexp_replace(replace({PLAIN}, chr(13), ''), '[ \t]*\n[ \t]*', chr(10), 'g'), concat(' ', chr(10), chr(9)))"


@query(f"SELECT page_id, md5({PLAIN}) AS plain FROM pages")
def x3_html_text(spark, sf):
    """References count where they end in a semicolon; others are text."""
    return table(spark, sf, "pages").select("page_id", F.md5(M.html_text_closed_udf("html")).alias("plain"))


@query()
def x22_paragraphs(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(M.html_paragraphs_udf("html")).alias("pos", "paragraph"))


@query("SELECT page_id, concat('url ', page_id) AS status, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1), '<[^>]+>', '', 'g'), '&amp;', '&', 'g'), '\\s+', ' ', 'g')) AS ad, 2 AS fields FROM pages")
def x23_fields(spark, sf):
    """Fields by class: one put around a page, and the advertisement that every page has."""
    wrapped = F.concat(F.lit('<div class="x ad-field-status"><div class="in"><p>url '), F.col("page_id").cast("string"), F.lit("</p></div></div>"), "html")
    own = table(spark, sf, "pages").select("page_id", M.html_fields_of("ad")(wrapped).alias("f"))
    return own.select("page_id", F.col("f")["-field-status"][0].alias("status"), F.array_join(F.col("f")[""], " ").alias("ad"), F.size("f").alias("fields"))


@query("SELECT doc_id, md5(text) AS decoded FROM documents")
def x1_decode(spark, sf):
    """Bytes whose declared character set is wrong or unknown come back as the text that they were; a third of the texts is not in UTF-8."""
    charset = F.when(F.col("doc_id") % 3 == 0, "no-such-charset").when(F.col("doc_id") % 3 == 1, "utf-8")
    western = (F.col("doc_id") % 3 == 1) & F.col("text").rlike(r"\A[\x00-\x7F\u00A0-\u00FF]*\z")
    raw = F.when(western, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", F.md5(M.decode_udf(raw, charset)).alias("decoded"))


@query("SELECT event_id, concat('Grüße ', event_type) AS subject FROM events")
def x2_headers(spark, sf):
    encoded = F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(F.concat(F.lit("Grüße "), "event_type"), "UTF-8")), F.lit("?="))
    return table(spark, sf, "events").select("event_id", M.header_udf(encoded).alias("subject"))


LABELS = [(1, "made (was made by)"), (2, "has note"), (3, "took place (at) (witnessed)"), (4, " knows  (knows)")]


@query(rf"SELECT id, CASE WHEN regexp_matches(t, '^(.*?)\s*\(([^()]*)\)\s*$') THEN regexp_extract(t, '^(.*?)\s*\(([^()]*)\)\s*$', 1) ELSE trim(t) END AS direct, CASE WHEN regexp_matches(t, '^(.*?)\s*\(([^()]*)\)\s*$') THEN regexp_extract(t, '^(.*?)\s*\(([^()]*)\)\s*$', 2) END AS inverse FROM {sql_values(LABELS, 'id', 't')}")
def x29_label_split(spark, sf):
    return values(spark, "id int, t string", LABELS).select("id", X.direct_and_inverse("t").alias("s")).select("id", "s.direct", "s.inverse")


@query(rf"SELECT doc_id, left(coalesce(nullif(regexp_extract(trim(regexp_replace(text, '\s+', ' ', 'g')), '^(.*?[.!?])\s+\p{{Lu}}', 1), ''), trim(regexp_replace(text, '\s+', ' ', 'g'))), 200) AS gloss FROM documents")
def x25_first_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.first_sentence("text").alias("gloss"))
