"""Text expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic marks and their plain forms, reply prefixes, months, apparatus headings; patterns of issue
# numbers, digest banners, identifiers, dates, quote marks and attributions.
TYPOGRAPHIC, PLAIN = "‘’‚′“”„″", "''''\"\"\"\""
REPLY_PREFIXES = ("re", "fwd", "aw", "fw", "sv", "vs", "antw")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
APPARATUS = ("works cited", "bibliography", "references", "further reading", "see also")
ISSUE = r"(?i)\bissues?(?:[ \t]+[:#]?[ \t]*|[:#][ \t]*)(\d{1,4}(?!\d)(?!\s*(?:st|nd|rd|th)\b))"
DIGEST = r"(?i)\bdigest,?\s*vol\.?\s*\d+,?\s*issue\s*\d+"
IDENTIFIER = r"\b([EP]\d{1,3})(?:\.\d)?i?\b"
NUMERIC_DATE = r"\b(\d{1,2})[/.](\d{1,2})[/.]((?:19|20)\d{2})\b"
YEAR = r"\b(19[89]\d|20[0-5]\d)\b"
DAY = r"\b(\d{1,2})(?:st|nd|rd|th)?\b"
LEAD_MARKS = r"^(\s*[>|]+)+\s?"
QUOTED_LINE = r"^\s*(>|\|(?!.*\|)(?=\s*\S))"
SAID = r"(?:wrote:|writes:|schrieb:?|escribi[oó]:?|ha scritto:?|a écrit|schreef)"
FORWARDED = r"-{2,}\s*Original Message"


#: Small Latin letters that are a letter of a to z with marks, and those letters.
_MARKED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]) if c.islower() and len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii()}
MARKED, BARE = "".join(_MARKED), "".join(_MARKED.values())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(text: Column | str) -> Column:
    """Lower case, without the marks of Latin letters."""
    low = F.lower(col(text))
    bare = F.regexp_replace(F.translate(low, MARKED, BARE), r"\p{Mn}+", "")
    return F.when(low.rlike(r"[^\x00-\x7F]"), bare).otherwise(low)


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits, in order, lower-cased and without marks: `naïve` is `naive`."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def collapsed(text: Column | str) -> Column:
    """Every run of white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def match_form(text: Column | str) -> Column:
    """Form in which quotations are compared: plain quote marks, single spaces, none before punctuation. Case stays."""
    spaced = F.regexp_replace(F.translate(col(text), TYPOGRAPHIC, PLAIN), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+([.,;:?!])", "$1"))


def paragraph_key(text: Column | str) -> Column:
    """Key under which a paragraph equals its quoted or re-wrapped copy: quote marks at line begins go, case is folded."""
    unquoted = F.regexp_replace(col(text), r"(?m)^[ \t]*(?:[>|][ \t]*)+", "")
    return F.lower(match_form(unquoted))


def subject_key(subject: Column | str, list_tag: str = r"(?i)\[list\]\s*") -> Column:
    """Subject without list tag, `(was: ...)` and reply prefixes, collapsed and lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col(subject), F.lit("")), list_tag, ""), r"(?is)\(was:.*?\)", "")
    return F.lower(collapsed(F.regexp_replace(F.trim(bare), rf"(?i)^\s*((?:{'|'.join(REPLY_PREFIXES)})\s*:\s*)+", "")))


def hash_id(text: Column | str) -> Column:
    return F.substring(F.sha1(col(text).cast("binary")), 1, 16)


def content_key(text: Column | str, sample: int = 4000) -> Column:
    """Hash of a text's own words: equal for the same words in another file format."""
    plain = F.regexp_replace(F.lower(col(text)), r"[^a-z0-9 ]+", " ")
    return F.sha2(F.substring(F.trim(F.regexp_replace(plain, r" +", " ")), 1, sample), 256)


def issue_numbers(text: Column | str) -> Column:
    """Distinct numbers that stand right after the word issue; digest banners and ordinals don't count."""
    sieved = F.regexp_replace(F.coalesce(col(text), F.lit("")), DIGEST, " ")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(sieved, F.lit(ISSUE), F.lit(1)), lambda n: n.cast("int"))))


def identifiers(text: Column | str, pattern: str = IDENTIFIER) -> Column:
    """Distinct base identifiers; `.1` and inverse `i` suffixes fold into the base."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern), F.lit(1))))


def known_and_former(ids: Column, known: Column) -> Column:
    """Identifiers split into those of the model and others: struct of current and historical."""
    return F.struct(F.array_intersect(ids, known).alias("current"), F.array_except(ids, known).alias("historical"))


def bare_number(text: Column | str) -> Column:
    """The number that a heading such as `204: done` begins with, else null."""
    return F.regexp_extract(col(text), r"^\s*(\d{1,4})\s*[:.)]\s*\S", 1).try_cast("int")


def heading_issues(text: Column | str, registered: Column | None = None, most: int = 8) -> Column:
    """Issue numbers of a heading such as `Issue 172, 173`, in order; registered: whether bare_number is known as an issue."""
    run = F.regexp_extract(col(text), r"(?i)^\s*issues?\s*[:#]?\s*((?:\d{1,4})(?:\s*(?:,|&|and|/)\s*\d{1,4})*)", 1)
    named = F.slice(F.transform(F.regexp_extract_all(run, F.lit(r"\d{1,4}"), F.lit(0)), lambda n: n.cast("int")), 1, most)
    return named if registered is None else F.when((F.size(named) == 0) & registered, F.array(bare_number(text))).otherwise(named)


def leading_id(raw: Column | str) -> Column:
    """The identifier at the begin of any spelling (`e22_Object`, `P14.1`), without suffixes; null if there is none."""
    ident = F.regexp_replace(F.replace(F.upper(F.trim(col(raw))), F.lit("LRM "), F.lit("LRM-")), r"\.\d$", "")
    return F.nullif(F.regexp_extract(ident, r"^([A-Z]{1,4}(?:-[A-Z])?\d{1,3})", 1), F.lit(""))


def day_of(date: Column | str) -> Column:
    return F.coalesce(F.substring(col(date), 1, 10), F.lit("??????????"))


def quotations(prose: Column | str, words: int = 5) -> Column:
    """Quoted spans of 25 to 400 characters and at least five words; a mark opens after a space or bracket and closes before a space or a stop."""
    marked = F.regexp_extract_all(col(prose), F.lit(r"""(?:(?<=^)|(?<=[\s(\[]))(?:'[^']{25,400}'|"[^"]{25,400}"|“[^”]{25,400}”)(?=$|[\s.,;:)\]?!])"""), F.lit(0))
    spans = F.transform(marked, lambda m: F.trim(F.substring(m, 2, F.length(m) - 2)))
    return F.filter(spans, lambda s: F.size(F.split(s, r"\s+")) >= words)


def reference_entries(citations: Column | str) -> Column:
    """Citations that are a text or an object with id and quote, as structs (from a JSON array)."""
    own = F.from_json(col(citations), "array<string>")
    is_object = lambda c: F.startswith(F.trim(c), F.lit("{"))
    return F.transform(own, lambda c: F.struct(F.when(is_object(c), F.get_json_object(c, "$.id")).otherwise(c).alias("id"), F.when(is_object(c), F.get_json_object(c, "$.quote")).alias("quote")))


def meeting_key(date: Column | str) -> Column:
    """Sortable (undated, year, month, day) of a free-form date: numeric ones are read day first, 99 stands for unknown."""
    d = F.coalesce(col(date), F.lit(""))
    year = F.regexp_extract(d, YEAR, 1)
    month = F.lit(99)
    for n, name in reversed(list(enumerate(MONTHS, 1))):
        month = F.when(F.contains(F.lower(d), F.lit(name)), F.lit(n)).otherwise(month)
    days = F.transform(F.regexp_extract_all(d, F.lit(DAY), F.lit(1)), lambda x: x.cast("int"))
    day = F.try_element_at(F.filter(days, lambda x: (x != F.pmod(year.cast("int"), F.lit(100))) & x.between(1, 31)), F.lit(1))
    key = lambda *parts: F.struct(*[p.cast("int").alias(n) for p, n in zip(parts, ("undated", "year", "month", "day"), strict=True)])
    part = lambda k: F.regexp_extract(d, NUMERIC_DATE, k)
    return F.when(d.rlike(NUMERIC_DATE), key(F.lit(0), part(3), part(2), part(1))).when(year == "", key(F.lit(1), F.lit(9999), F.lit(99), F.lit(99))).otherwise(key(F.lit(0), year, month, F.coalesce(day, F.lit(99))))


def quote_depth(line: Column | str) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(col(line), LEAD_MARKS, 0), r"[^>|]", ""))


def unquoted(line: Column | str) -> Column:
    return F.regexp_replace(col(line), LEAD_MARKS, "")


def is_quoted(line: Column | str) -> Column:
    """`>` opens a quotation; `|` does if content follows and no second `|` does."""
    return col(line).rlike(QUOTED_LINE)


def is_attribution(line: Column | str) -> Column:
    """The line that introduces a quotation, in six languages."""
    bare = F.trim(col(line))
    original = bare.rlike(f"(?i){FORWARDED}")
    said = bare.rlike(f"(?i){SAID}")
    return (bare != "") & (F.length(bare) <= 200) & (original | (said & bare.endswith(":")))


def first_sentence(text: Column | str, most: int = 200) -> Column:
    """Up to the first full stop before a capital, at most `most` characters."""
    flat = collapsed(text)
    return F.substring(F.coalesce(F.nullif(F.regexp_extract(flat, r"^(.*?[.!?])(?=\s+\p{Lu})", 1), F.lit("")), flat), 1, most)


def local_name(uri: Column | str) -> Column:
    return F.regexp_extract(col(uri), r"([^/#]+)/?$", 1)


def namespace_of(uri: Column | str) -> Column:
    return F.regexp_extract(col(uri), r"^(.*[/#])[^/#]*$", 1)


def label_key(label: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def direct_and_inverse(label: Column | str) -> Column:
    """`direct (inverse)` split at the last bracket."""
    parts = r"^(.*?)\s*\(([^()]*)\)\s*$"
    has = col(label).rlike(parts)
    return F.struct(F.when(has, F.regexp_extract(col(label), parts, 1)).otherwise(F.trim(col(label))).alias("direct"), F.when(has, F.regexp_extract(col(label), parts, 2)).alias("inverse"))


def is_apparatus(section_path: Column | str, heading: Column | str) -> Column:
    """Whether a chunk is a bibliography or the like, by its section path, else by its heading."""
    where = F.lower(F.coalesce(F.nullif(F.array_join(col(section_path), " > "), F.lit("")), col(heading), F.lit("")))
    return where.rlike("|".join(APPARATUS))


def year_of(date: Column | str) -> Column:
    """Leading year of an ISO date; 0 if there is none."""
    return F.coalesce(F.substring(col(date), 1, 4).try_cast("int"), F.lit(0))
