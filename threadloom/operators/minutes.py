"""Meeting records: header fields, sections under headings, chunks, links to issues, and the collection of all meetings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.chunking import MINUTES_SIZE, sentence_pack
from ..functions.rows import per_row_of_two

# Paragraphs that hold a header, least length of a chunk without issues, patterns of titles, dates and years.
HEAD_PARAGRAPHS, LEAST_CHARS = 25, 120
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
TITLE = r"(?i)\b(\d{1,3})(?:st|nd|rd|th)?\s+(?:joint\s+)?meeting\b"  # archives may add the names of their bodies
DATES = (
    rf"(?i)\b(?:\d{{1,2}}(?:st|nd|rd|th)?\s*[-–]\s*)?\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH}\s*,?\s*(?:19|20)\d{{2}}\b",
    rf"(?i)\b{_MONTH}\s*,?\s*(?:19|20)\d{{2}}\b",
    r"\b\d{1,2}[/.]\d{1,2}[/.](?:19|20)\d{2}\b",
    r"\b(?:19|20)\d{2}-\d{1,2}-\d{1,2}\b",
)
BARE_YEAR = r"\b(19[89]\d|20[0-4]\d)\b"
PREAMBLE = "Preamble"


def headers(paragraphs: DataFrame, title_pattern: str = TITLE) -> DataFrame:
    """doc, title, date, venue from the first paragraphs (doc, pos, text); what isn't there is null.

    The title is the first paragraph that numbers a meeting, else the first of more than 15 characters; the date is looked for
    in all of them joined, the most specific form first; the venue follows the title.
    """
    n = F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
    head = paragraphs.withColumn("n", n).where(F.col("n") <= HEAD_PARAGRAPHS).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("head"))
    long = F.filter("head", lambda t: F.length(t) > 15)
    title = F.coalesce(F.get(F.filter(long, lambda t: t.rlike(title_pattern)), 0), F.get(long, 0))
    joined = F.array_join("head", " ")
    date = F.coalesce(*[F.nullif(F.regexp_extract(joined, p, 0), F.lit("")) for p in (*DATES, BARE_YEAR)])
    after = F.slice("head", F.array_position("head", F.col("title")).cast("int") + 1, 4)
    venue = F.get(F.filter(after, lambda t: (F.length(t) > 3) & (F.length(t) < 120) & ~t.rlike("|".join(f"(?:{p})" for p in DATES))), 0)
    found = head.withColumn("title", title).withColumn("date", X.collapsed(date))
    return found.select("doc", "title", "date", F.when(F.col("title").isNotNull(), venue).alias("venue"))


def sections(paragraphs: DataFrame, register: DataFrame | None = None, numbered: Column | None = None) -> DataFrame:
    """doc, section (from 0), heading, issues, body of the paragraphs (doc, pos, style, text) under each heading.

    A heading has a heading style, names an issue, or begins with a number that the register (issue) knows. What stands before the
    first heading is the preamble; a heading with neither body nor issues is no section. numbered: which paragraphs may be
    headings by a bare number, where the source tells (else all may, even one that begins with an address or a time).
    """
    marked = paragraphs.withColumn("bare", X.bare_number("text"))
    if register is not None:
        marked = marked.join(register.select(F.col("issue").cast("int").alias("bare"), F.lit(True).alias("known")).distinct(), "bare", "left")
    known = F.coalesce(F.col("known"), F.lit(False)) if register is not None else F.lit(False)
    known = known if numbered is None else known & numbered
    own = marked.withColumn("issues", X.heading_issues("text", known))
    heads = F.coalesce(F.startswith("style", F.lit("Heading")), F.lit(False)) | (F.size("issues") > 0)
    so_far = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cut = own.withColumn("is_head", heads).withColumn("nth", F.sum(F.col("is_head").cast("int")).over(so_far))
    line = F.when(~F.col("is_head"), F.struct("pos", "text"))
    whole = cut.groupBy("doc", "nth").agg(F.max(F.when(F.col("is_head"), F.col("text"))).alias("heading"), F.max(F.when(F.col("is_head"), F.col("issues"))).alias("issues"), F.array_sort(F.collect_list(line)).alias("lines"))
    kept = whole.withColumn("issues", F.coalesce("issues", F.array().cast("array<int>"))).where((F.size("lines") > 0) | (F.size("issues") > 0))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("nth")) - 1
    body = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), r"^\s+|\s+$", "")
    return kept.select("doc", number.alias("section"), F.coalesce("heading", F.lit(PREAMBLE)).alias("heading"), "issues", body.alias("body"))


_packed = per_row_of_two(lambda text, limit: sentence_pack(text or "", int(limit)), T.ArrayType(T.StringType()))


def _chunk_id(part: Column | None = None) -> Column:
    own = F.concat(F.lit("minutes:"), F.col("doc"), F.lit("#s"), F.when(F.col("section") < 1000, F.lpad(F.col("section").cast("string"), 3, "0")).otherwise(F.col("section").cast("string")))
    return own if part is None else F.concat(own, F.when(part > 0, F.concat(F.lit("-"), part.cast("string"))).otherwise(""))


def chunks(found: DataFrame, meetings: DataFrame) -> DataFrame:
    """chunk_id, doc, title, heading, cite, date, venue, issues, text from sections and headers: the heading leads each piece, and
    bodies are cut to whole sentences. Short sections without issues and sections without a body have no chunk."""
    own = found.join(meetings, "doc", "left").withColumn("title", F.coalesce("title", "doc")).where((F.col("body") != "") & ((F.length("body") >= LEAST_CHARS) | (F.size("issues") > 0)))
    head = F.when(F.col("heading") == PREAMBLE, "").otherwise(F.col("heading"))
    room = F.greatest(F.lit(LEAST_CHARS), F.lit(MINUTES_SIZE) - F.length(head) - 1)
    pieces = own.withColumn("head", head).select("*", F.posexplode(_packed("body", room)).alias("part", "piece"))
    text = F.when(F.col("head") == "", F.col("piece")).otherwise(F.regexp_replace(F.concat("head", F.lit("\n"), "piece"), r"^\s+|\s+$", ""))
    cite = F.concat("title", F.coalesce(F.concat(F.lit(", "), F.col("date")), F.lit("")), F.lit(" — "), "heading")
    return pieces.select(_chunk_id(F.col("part")).alias("chunk_id"), "doc", "title", "heading", cite.alias("cite"), "date", "venue", "issues", text.alias("text"))


def issue_links(found: DataFrame, meetings: DataFrame) -> DataFrame:
    """issue, doc_id, title, date, heading, chunk_id, chars, place: a row for each issue of a section, even one without a body."""
    own = found.join(meetings, "doc", "left").select("*", F.explode("issues").alias("issue"))
    return own.select("issue", F.col("doc").alias("doc_id"), F.coalesce("title", "doc").alias("title"), "date", "heading", F.when(F.col("body") != "", _chunk_id()).alias("chunk_id"), F.length("body").alias("chars"), F.concat_ws("#", "doc", F.lpad(F.col("section").cast("string"), 6, "0")).alias("place"))


def collect(paragraphs: DataFrame, files: DataFrame, register: DataFrame | None = None) -> dict[str, DataFrame]:
    """All meetings: chunks, links, unreadable files (file, error) and groups of meetings with the same words in other formats.

    paragraphs: doc, pos, style, text; files: doc, error (null where it was read). A file without text is unreadable.
    """
    found, meetings = sections(paragraphs, register), headers(paragraphs)
    texts = paragraphs.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("whole"))
    unreadable = files.join(texts.select("doc"), "doc", "left_anti").select("doc", F.coalesce("error", F.lit("no text extracted")).alias("error")).unionByName(files.join(texts.select("doc"), "doc", "left_semi").where("error IS NOT NULL").select("doc", "error"))
    groups = texts.groupBy(X.content_key("whole").alias("key")).agg(F.array_sort(F.collect_list("doc")).alias("members")).where(F.size("members") > 1)
    return {"chunks": chunks(found, meetings), "issue_links": issue_links(found, meetings), "unreadable": unreadable, "duplicates": groups}
