"""Records of all kinds: chunks of documents, issue pages and episodes, rows of their indexes, and reading by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.chunking import recursive_split_udf
from ..functions.mail import html_fields_of
from .corpus import heading_path

CHUNK = ("chunk_id", "doc_id", "doc_title", "cite", "kind", "concept_id", "section_path", "heading", "text", "entities", "entities_historical")


def _entities(df: DataFrame, known: Column, pattern: str = X.IDENTIFIER) -> DataFrame:
    found = X.known_and_former(X.identifiers("text", pattern), known)
    return df.withColumn("__e", found).select("*", F.col("__e.current").alias("entities"), F.col("__e.historical").alias("entities_historical")).select(*CHUNK)


def document_blocks(paragraphs: DataFrame, label_styles: list[str], skip_tables_under: tuple[str, ...] = (), levels: int = 4) -> DataFrame:
    """Blocks (doc_id, pos, kind, concept_id, section_path, heading, text) of paragraphs (doc_id, pos, style, text).

    A heading style (`Heading 2`) opens a narrative block and moves the path; a label style opens the declaration of the concept that
    its text begins with. All else belongs to the block that is open; what stands before the first one is dropped, as are
    narrative blocks without text and tables under the headings that are named.
    """
    level = F.regexp_extract("style", rf"^Heading ?([1-{levels}])$", 1).try_cast("int")
    marked = paragraphs.withColumn("style", F.coalesce("style", F.lit(""))).withColumn("level", level).withColumn("is_label", F.col("style").isin(label_styles))
    placed = heading_path(marked, "doc_id", "pos", "level", "text", levels)
    own = placed.where(~((F.col("style") == "Table") & F.coalesce(F.get("path", 0).isin(*skip_tables_under), F.lit(False)))) if skip_tables_under else placed
    opens = F.col("level").isNotNull() | F.col("is_label")
    cut = own.withColumn("opens", opens).withColumn("nth", F.sum(opens.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("nth > 0")
    line = F.when(~F.col("opens") & (F.trim("text") != ""), F.struct("pos", F.trim("text").alias("text")))
    head = lambda c: F.max(F.when(F.col("opens"), F.col(c)))
    blocks = cut.groupBy("doc_id", "nth").agg(head("pos").alias("pos"), head("is_label").alias("is_label"), head("text").alias("heading"), F.max(F.when(F.col("opens"), F.struct("pos", "path"))).alias("p"), F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    kind = F.when(F.col("is_label"), "declaration").otherwise("narrative")
    concept = F.when(F.col("is_label"), F.nullif(F.regexp_extract("heading", r"^([A-Z]+\d+)\b", 1), F.lit("")))
    out = blocks.select("doc_id", "pos", kind.alias("kind"), concept.alias("concept_id"), F.col("p.path").alias("section_path"), F.trim("heading").alias("heading"), text.alias("text"))
    return out.where((F.col("kind") == "declaration") | (F.col("text") != ""))


def _numbered(prefix: Column, number: Column, width: int = 4) -> Column:
    return F.concat(prefix, F.lit("s"), F.when(number < 10**width, F.lpad(number.cast("string"), width, "0")).otherwise(number.cast("string")))


def document_chunks(blocks: DataFrame, specs: DataFrame, known: Column, pattern: str = X.IDENTIFIER) -> DataFrame:
    """Chunks of every registered document: declarations whole under their concept, narrative cut and numbered through the document.

    blocks: doc_id, pos, kind, concept_id, section_path, heading, text; specs: doc_id, title, cite, kind (null: narrative).
    """
    own = blocks.join(specs.select("doc_id", F.col("title").alias("doc_title"), "cite", F.col("kind").alias("own_kind")), "doc_id")
    whole = own.where("kind = 'declaration'").withColumn("chunk_id", F.concat("doc_id", F.lit("#"), "concept_id"))
    cut = own.where("kind <> 'declaration'").withColumn("kind", F.coalesce(F.nullif("own_kind", F.lit("")), F.lit("narrative"))).withColumn("concept_id", F.lit(None).cast("string"))
    pieces = cut.select(*[c for c in cut.columns if c != "text"], F.posexplode(recursive_split_udf("text")).alias("part", "text")).where(F.trim("text") != "")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "part")) - 1
    pieces = pieces.withColumn("chunk_id", _numbered(F.concat("doc_id", F.lit("#")), number))
    columns = [c for c in CHUNK if not c.startswith("entities")]
    return _entities(whole.select(*columns).unionByName(pieces.select(*columns)), known, pattern)


def issue_pages(pages: DataFrame, slugs: dict[str, str], prefix: str = "field--name-") -> DataFrame:
    """issue, outcome, background, current, old, references of cached pages (id, html) by the names that the site gives its fields.

    slugs: outcome, background, current, old and references, each to the end of a field's class. The outcome is one text; the others
    are paragraphs; a field that a page lacks is null.
    """
    found = pages.select(F.col("id").alias("issue"), html_fields_of(prefix)("html").alias("f"))
    part = lambda name: F.try_element_at("f", F.lit(slugs[name]))
    return found.select("issue", F.nullif(F.array_join(part("outcome"), "\n"), F.lit("")).alias("outcome"), *[part(x).alias(x) for x in ("background", "current", "old", "references")])


PARTS = (("background", "Background"), ("current", "Current Proposal"), ("old", "Old Proposal"))


def issue_chunks(pages: DataFrame, register: DataFrame, archive_keys: DataFrame, known: Column, pattern: str = X.IDENTIFIER) -> tuple[DataFrame, DataFrame]:
    """Chunks of issue pages, and by issue how many paragraphs and characters of them were kept and dropped.

    The outcome is a chunk whole; background and proposals lose the paragraphs that the archive has (archive_keys: key) and the rest
    is cut. Every citation tells the status. pages: issue, outcome, background, current, old (arrays of paragraphs).
    """
    titled = pages.join(register.select("issue", "title", "status"), "issue", "left")
    cite = F.concat(F.lit("Issue "), F.col("issue").cast("string"), F.lit(" ("), F.coalesce(F.nullif("status", F.lit("")), F.lit("?")), F.lit("): "), F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Issue "), F.col("issue").cast("string"))))
    base = titled.withColumn("cite", cite).withColumn("doc_id", F.concat(F.lit("issue"), F.col("issue").cast("string"))).withColumn("doc_title", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Issue "), F.col("issue").cast("string"))))
    shape = lambda df: df.select("chunk_id", "doc_id", "doc_title", "cite", F.lit("issue").alias("kind"), F.lit(None).cast("string").alias("concept_id"), F.array(F.concat(F.lit("Issue "), F.col("issue").cast("string")), F.col("heading")).alias("section_path"), "heading", "text")
    outcome = base.where(F.coalesce("outcome", F.lit("")) != "").withColumn("chunk_id", F.concat("doc_id", F.lit("#outcome"))).withColumn("heading", F.lit("Outcome")).withColumn("text", F.col("outcome"))
    none = F.array().cast("array<string>")
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.lit(tag).alias("tag"), F.lit(heading).alias("heading"), F.coalesce(tag, none).alias("paragraphs")) for k, (tag, heading) in enumerate(PARTS)]))
    rows = base.select("issue", "doc_id", "doc_title", "cite", listed.alias("p")).select("issue", "doc_id", "doc_title", "cite", "p.n", "p.tag", "p.heading", F.posexplode("p.paragraphs").alias("pos", "paragraph"))
    keyed = rows.withColumn("key", X.paragraph_key("paragraph")).join(archive_keys.select("key", F.lit(True).alias("there")).distinct(), "key", "left").withColumn("dropped", F.coalesce("there", F.lit(False)))
    size = lambda flag: F.coalesce(F.sum(F.when(flag, F.length("paragraph"))), F.lit(0))
    stats = keyed.groupBy("issue").agg(F.count_if(~F.col("dropped")).alias("kept"), F.count_if("dropped").alias("dropped"), size(~F.col("dropped")).alias("kept_chars"), size(F.col("dropped")).alias("dropped_chars"))
    kept = keyed.where("NOT dropped").groupBy("issue", "doc_id", "doc_title", "cite", "n", "tag", "heading").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))), lambda x: x["paragraph"]), "\n\n").alias("blob"))
    pieces = kept.select("*", F.posexplode(recursive_split_udf("blob")).alias("part", "text")).where(F.trim("text") != "")
    pieces = pieces.withColumn("chunk_id", _numbered(F.concat("doc_id", F.lit("#"), "tag", F.lit("-")), F.col("part")))
    return _entities(shape(outcome).unionByName(shape(pieces)), known, pattern), stats


#: How many of a list are told at most.
MOST_TOLD = {"siblings": 10, "narratives": 3, "entities": 6, "heading_issues": 8}


def told(column: Column | str, kind: str) -> Column:
    """The part of a sorted list that an answer tells."""
    return F.slice(X.col(column), 1, MOST_TOLD[kind])


def all_records(*kinds: DataFrame) -> DataFrame:
    """Records of several kinds as one table; what a kind lacks is null."""
    out = kinds[0]
    for df in kinds[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def episode_text(topic: str = "topic", question: str = "question", positions: str = "positions", detail: str = "outcome_detail", entities: str = "entities") -> Column:
    """What an episode is searched by: topic, question, who said what, how it ended, its concepts; empty parts are left out."""
    said = F.array_join(F.transform(F.col(positions), lambda p: F.concat_ws(": ", F.coalesce(p["who"], F.lit("None")), F.coalesce(p["position"], F.lit("None")))), " ")
    parts = F.array(F.col(topic), F.col(question), said, F.col(detail), F.array_join(F.col(entities), " "))
    return F.trim(F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), "\n"))


def episode_rows(episodes: DataFrame) -> DataFrame:
    """Index rows of episodes: chunk_id, message_id, thread_id, subject, from_name, body, entities. The title is the topic, never the outcome's word."""
    none = F.array().cast("array<string>")
    entities = F.array_join(F.concat(F.coalesce("entities", none), F.coalesce("entities_extension", none)), " ")
    own = episodes.withColumn("body", episode_text()).where("body <> ''")
    return own.select(F.col("episode_id").alias("chunk_id"), F.col("episode_id").alias("message_id"), "thread_id", F.coalesce("topic", F.lit("")).alias("subject"), F.lit("").alias("from_name"), "body", entities.alias("entities"))


def document_rows(records: DataFrame) -> DataFrame:
    """Index rows of document chunks: lists joined, nulls empty, both kinds of entities in one column; chunks without text go."""
    none = F.array().cast("array<string>")
    text = F.trim(F.coalesce("text", F.lit("")))
    entities = F.array_join(F.concat(F.coalesce("entities", none), F.coalesce("entities_historical", none)), " ")
    return records.where(text != "").select("chunk_id", "doc_id", "doc_title", "cite", "kind", F.coalesce("concept_id", F.lit("")).alias("concept_id"), F.array_join(F.coalesce("section_path", none), " > ").alias("section_path"), F.coalesce("heading", F.lit("")).alias("heading"), entities.alias("entities"), text.alias("text"))


def corpus_stats(records: DataFrame) -> DataFrame:
    """kind, chunks, chars, documents, linked issues (distinct) of all document records together."""
    none = F.array().cast("array<int>")
    own = records.select("kind", "doc_id", F.length("text").alias("n"), F.explode_outer(F.coalesce("issues", none)).alias("issue"), "chunk_id")
    once = own.dropDuplicates(["kind", "chunk_id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("chars"), F.count_distinct("doc_id").alias("documents"))
    return once.join(own.groupBy("kind").agg(F.count_distinct("issue").alias("issues")), "kind")


# ---- reading by id -----------------------------------------------------------------------------------------------


def show(asked: DataFrame, messages: DataFrame, documents: DataFrame) -> DataFrame:
    """asked, kind, id, title, text: a message by its own id or its Message-ID, else a document chunk; kind is null for what is neither.

    messages: id, message_id, subject, body; documents: chunk_id, heading, text.
    """
    own = asked.select(F.trim("asked").alias("key"), "asked").distinct()
    by_id = messages.select(F.col("id").alias("key"), F.lit(0).alias("prio"), F.lit("message").alias("kind"), F.col("id").alias("id"), F.col("subject").alias("title"), F.col("body").alias("text"))
    by_header = messages.select(F.col("message_id").alias("key"), F.lit(1).alias("prio"), F.lit("message").alias("kind"), "id", F.col("subject").alias("title"), F.col("body").alias("text"))
    by_chunk = documents.select(F.col("chunk_id").alias("key"), F.lit(2).alias("prio"), F.lit("document").alias("kind"), F.col("chunk_id").alias("id"), F.col("heading").alias("title"), "text")
    met = own.join(by_id.unionByName(by_header).unionByName(by_chunk), "key")
    best = met.groupBy("asked").agg(F.min(F.struct("prio", "id", "kind", "title", "text")).alias("b"))
    return own.select("asked").join(best, "asked", "left").select("asked", "b.kind", "b.id", "b.title", "b.text")


def read_threads(asked: DataFrame, members: DataFrame, messages: DataFrame) -> DataFrame:
    """thread, index, and the columns of messages (id, ...) of the asked threads, in order; members that have no record keep their place free."""
    return asked.select("thread").distinct().join(members.select("thread", "id", "index"), "thread").join(messages, "id").orderBy("thread", "index")


def issue_records(asked: DataFrame, index: DataFrame, register: DataFrame, pages: DataFrame, meetings: DataFrame) -> DataFrame:
    """issue, title, status, thread_count, threads, outcome, meetings, found: all that is known of each asked issue."""
    own = asked.select(F.col("issue").cast("int").alias("issue")).distinct()
    parts = own.join(register.select("issue", "title", "status", F.lit(True).alias("registered")), "issue", "left").join(index.select("issue", "thread_count", "threads"), "issue", "left")
    parts = parts.join(pages.select("issue", "outcome"), "issue", "left").join(meetings.select("issue", "meetings"), "issue", "left")
    found = F.coalesce("registered", F.lit(False)) | F.col("thread_count").isNotNull() | F.col("outcome").isNotNull() | F.col("meetings").isNotNull()
    return parts.select("issue", "title", "status", F.coalesce("thread_count", F.lit(0)).alias("thread_count"), "threads", "outcome", "meetings", found.alias("found"))


def declaration_parts(asked: DataFrame, documents: DataFrame, doc_id: str) -> DataFrame:
    """concept, fol, full_path, cite from the declaration of each asked concept; concepts without one are left out."""
    from ..sources.ontology import declaration_section

    own = asked.select("concept").distinct().withColumn("chunk_id", F.concat(F.lit(f"{doc_id}#"), "concept")).join(documents.select("chunk_id", "text", "cite"), "chunk_id")
    part = lambda header: F.nullif(F.array_join(declaration_section("text", header), "\n"), F.lit(""))
    return own.select("concept", part("In first-order logic:").alias("fol"), part("Full path:").alias("full_path"), "cite")
