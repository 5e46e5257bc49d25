"""Whole RDF, XML and word-processor documents as rows, parsed in the workers."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = "doc_id string, subject string, predicate string, object string, object_is_literal boolean, language string, error string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SUFFIXES = {"ttl": "turtle", "n3": "turtle", "nt": "turtle", "rdf": "xml", "owl": "xml", "xml": "xml", "jsonld": "json", "json": "json"}


class Literal(str):
    """A literal's text with its language, if it has one."""

    language: str | None = None

    @classmethod
    def of(cls, text: str, language: str | None) -> Literal:
        out = cls(text)
        out.language = language or None
        return out

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<long>\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3})|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<prefix>@prefix|@base|PREFIX\b|BASE\b)|(?P<lang>@[A-Za-z-]+)|(?P<kind>\^\^)|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<blank>_:[\w.-]*\w)|(?P<name>[A-Za-z][\w.-]*(?<!\.)?:[^\s<>"'()\[\];,]*[^\s<>"'()\[\];,.]|[A-Za-z][\w.-]*:|:[^\s<>"'()\[\];,]*[^\s<>"'()\[\];,.])
    |(?P<word>a\b|true\b|false\b)|(?P<mark>[.;,\[\]()])""", re.X | re.S)  # fmt: skip


def turtle(source: str) -> Iterator[tuple[str, str, str, bool]]:
    """Triples of Turtle or N-Triples: prefixes, predicate and object lists, blank nodes, collections, typed literals."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ValueError(f"unexpected {source[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
    prefixes: dict[str, str] = {}
    base, count, i = "", 0, 0
    out: list[tuple[str, str, str, bool]] = []

    def resolve(kind: str, text: str) -> str:
        if kind == "iri":
            own = text[1:-1]
            return own if re.match(r"[A-Za-z][\w+.-]*:", own) else base + own
        if kind == "blank":
            return text
        if kind == "word" and text == "a":
            return RDF + "type"
        prefix, _, local = text.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return prefixes[prefix] + local

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:b{count}"

    def node() -> tuple[str, bool]:
        nonlocal i
        kind, text = tokens[i]
        i += 1
        if kind in ("text", "long"):
            quote = 3 if kind == "long" else 1
            value = re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[quote:-quote])
            if i < len(tokens) and tokens[i][0] == "lang":
                value = Literal.of(value, tokens[i][1][1:])
                i += 1
            elif i < len(tokens) and tokens[i][0] == "kind":
                i += 2
            return value, True
        if kind == "number" or text in ("true", "false"):
            return text, True
        if text == "[":
            own = fresh()
            if tokens[i][1] != "]":
                predicates(own)
            i += 1
            return own, False
        if text == "(":
            items = []
            while tokens[i][1] != ")":
                items.append(node())
            i += 1
            head = RDF + "nil"
            for value, literal in reversed(items):
                cell = fresh()
                out.extend([(cell, RDF + "first", value, literal), (cell, RDF + "rest", head, False)])
                head = cell
            return head, False
        return resolve(kind, text), False

    def predicates(subject: str) -> None:
        nonlocal i
        while True:
            predicate = resolve(*tokens[i])
            i += 1
            while True:
                value, literal = node()
                out.append((subject, predicate, value, literal))
                if i < len(tokens) and tokens[i][1] == ",":
                    i += 1
                    continue
                break
            while i < len(tokens) and tokens[i][1] == ";":
                i += 1
            if i >= len(tokens) or tokens[i][1] in ".]":
                return

    while i < len(tokens):
        kind, text = tokens[i]
        if kind == "prefix":
            if text.lower().endswith("base"):
                base = tokens[i + 1][1][1:-1]
                i += 2
            else:
                prefixes[tokens[i + 1][1].rstrip(":")] = resolve(*tokens[i + 2])
                i += 3
            if text.startswith("@"):
                i += 1
            continue
        subject, _ = node()
        if tokens[i][1] != ".":
            predicates(subject)
        i += 1
    yield from out


def rdf_xml(source: str) -> Iterator[tuple[str, str, str, bool]]:
    """Triples of striped RDF/XML: typed nodes, property elements with resource, nested node or literal."""
    base_key, count = "{http://www.w3.org/XML/1998/namespace}base", 0
    root = ElementTree.fromstring(source)
    name = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag
    base = root.get(base_key, "")

    def node(element: ElementTree.Element) -> Iterator[tuple[str, str, str, bool]]:
        nonlocal count
        about, ident = element.get(f"{{{RDF}}}about"), element.get(f"{{{RDF}}}ID")
        if about is None and ident is None:
            count += 1
        subject = (about if ":" in about else base + about) if about is not None else f"{base}#{ident}" if ident is not None else f"_:x{count}"
        subjects.append(subject)
        if name(element.tag) != RDF + "Description":
            yield subject, RDF + "type", name(element.tag), False
        for child in element:
            target = child.get(f"{{{RDF}}}resource")
            if target is not None:
                yield subject, name(child.tag), target if ":" in target else base + target, False
            elif len(child):
                for inner in child:
                    rows = list(node(inner))
                    yield subject, name(child.tag), subjects.pop(), False
                    yield from rows
            else:
                yield subject, name(child.tag), Literal.of(child.text or "", child.get("{http://www.w3.org/XML/1998/namespace}lang")), True

    subjects: list[str] = []
    for element in root if name(root.tag) == RDF + "RDF" else [root]:
        yield from list(node(element))
        subjects.clear()


def json_ld(source: str) -> Iterator[tuple[str, str, str, bool]]:
    """Triples of JSON-LD whose context stands in the document: prefixes, terms, @vocab, nested nodes, values and lists."""
    root = json.loads(source)
    nodes = root if isinstance(root, list) else [root]
    count = 0

    def context_of(node: dict, outer: dict) -> dict:
        own = node.get("@context") or {}
        merged = dict(outer)
        for part in own if isinstance(own, list) else [own]:
            if not isinstance(part, dict):
                raise ValueError("a context outside the document")
            merged |= {k: v["@id"] if isinstance(v, dict) and "@id" in v else v for k, v in part.items()}
        return merged

    def iri(term: str, context: dict, is_key: bool = False) -> str:
        if is_key and isinstance(context.get(term), str):
            term = context[term]
        prefix, colon, local = term.partition(":")
        if colon and prefix in context and not local.startswith("//"):
            return context[prefix] + local
        return term if colon or not is_key else context.get("@vocab", "") + term

    def walk(node: dict, outer: dict) -> Iterator[tuple[str, str, str, bool]]:
        nonlocal count
        context = context_of(node, outer)
        if "@id" not in node and not any(k not in ("@context", "@graph") for k in node):
            subject = ""
        elif "@id" in node:
            subject = iri(node["@id"], context)
        else:
            count += 1
            subject = f"_:j{count}"
        subjects.append(subject)
        for kind in _listed(node.get("@type", [])):
            yield subject, RDF + "type", iri(kind, context, True), False
        for key, value in node.items():
            if key == "@graph":
                for inner in _listed(value):
                    yield from walk(inner, context)
                    subjects.pop()
            elif not key.startswith("@"):
                for one in _listed(value["@list"] if isinstance(value, dict) and "@list" in value else value):
                    if isinstance(one, dict) and "@value" in one:
                        yield subject, iri(key, context, True), Literal.of(_plain(one["@value"]), one.get("@language")), True
                    elif isinstance(one, dict):
                        rows = list(walk(one, context))
                        yield subject, iri(key, context, True), subjects.pop(), False
                        yield from rows
                    else:
                        yield subject, iri(key, context, True), _plain(one), True

    subjects: list[str] = []
    for node in nodes:
        yield from walk(node, {})
        subjects.clear()


def _listed(value) -> list:
    return value if isinstance(value, list) else [value]


def _plain(value) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def _per_file(parse, names: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for path, content in zip(df["path"], df["content"], strict=True):
                try:
                    rows = [(path, *r, None) for r in parse(path, bytes(content))]
                except Exception as e:  # a document that can't be read is a row with its error, and the rest goes on
                    rows = [(path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"[:300])]
                yield pd.DataFrame(rows, columns=names)

    return run


def _triples(path: str, content: bytes):
    kind = SUFFIXES.get(path.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"unsupported format: {path}")
    text = content.decode("utf-8-sig")
    rows = {"turtle": turtle, "xml": rdf_xml, "json": json_ld}[kind](text)
    return ((s, p, str(o), literal, getattr(o, "language", None)) for s, p, o, literal in rows)


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """Triples of every document (format by suffix); what can't be parsed is one row with `error`."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_per_file(_triples, [x.split()[0] for x in TRIPLE.split(", ")]), TRIPLE)


LINK = "doc_id string, link string, subject string, name string, object string, path string, via_property string, error string"


#: Elements that are no properties, beside those of records, and how a class is named.
STRUCTURAL, CLASS_OF, CLASS_ID = ("in_class", "value", "unit"), "in_class", re.compile(r"\s*([A-Za-z]+\d+(?:\.\d)?)\s*[:.]")


def _placed(element: ElementTree.Element, path: str) -> Iterator[tuple[ElementTree.Element, str]]:
    """Children with their paths; a tag that repeats among its siblings is numbered."""
    repeated, seen = Counter(c.tag for c in element), Counter()
    for child in element:
        seen[child.tag] += 1
        yield child, f"{path}/{child.tag}" + (f"[{seen[child.tag]}]" if repeated[child.tag] > 1 else "")


def _class_of(element: ElementTree.Element) -> str | None:
    found = CLASS_ID.match(element.findtext(CLASS_OF) or "")
    return found[1] if found else None


def element_links(root: ElementTree.Element) -> list[tuple[str, str | None, str, str | None, str, str | None]]:
    """Links (link, subject, name, object, path, via) of each record's nested elements; records are the root's children that name a class.

    An element is named by its property. One with a class of its own is the subject of what it holds; one without is a literal, so
    what it holds qualifies the property (via). Structural elements are no links: they hand on what they stand in.
    """
    records = [r for r in root if r.find(CLASS_OF) is not None]
    structural = {*STRUCTURAL, *(r.tag for r in records)}
    out, todo = [], [(r, f"{r.tag}[{_class_of(r)}]", _class_of(r), None) for r in reversed(records)]
    while todo:
        element, path, subject, via = todo.pop()
        below = []
        for child, here in _placed(element, path):
            if child.tag == CLASS_OF:
                continue
            cls, name = _class_of(child), child.tag.replace("_", " ")
            is_link = child.tag not in structural
            if is_link:
                out.append((here, subject, name, cls, here, via))
            below.append((child, here, cls or subject, None if cls else name if is_link else via))
        todo += reversed(below)
    return out


def class_uses(root: ElementTree.Element) -> list[tuple[str, str | None, str, str]]:
    """(path, id, label, raw) of every class that an element names, in document order."""
    out, todo = [], [(root, "")]
    while todo:
        element, path = todo.pop()
        placed = list(_placed(element, path))
        for child, _ in placed:
            raw = (child.text or "").strip()
            if child.tag == CLASS_OF and raw:
                found = CLASS_ID.match(raw)
                out.append((path, found[1] if found else None, raw[found.end() :].strip() if found else "", raw))
        todo += reversed(placed)
    return out


USE = "doc_id string, path string, id string, label string, raw string, error string"


def read_class_uses(spark: SparkSession, path: str) -> DataFrame:
    """What validate.label_findings checks: every class that the documents name, with its label."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_per_file(lambda _, c: class_uses(ElementTree.fromstring(c)), [x.split()[0] for x in USE.split(", ")]), USE)


def read_xml_links(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_per_file(lambda _, c: element_links(ElementTree.fromstring(c)), [x.split()[0] for x in LINK.split(", ")]), LINK)


PARAGRAPH = "doc_id string, pos int, style string, text string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes) -> Iterator[tuple[int, str | None, str]]:
    """Paragraphs with their styles; a table row is one paragraph of style Table, merged cells once."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: " ".join("".join(t.text or "" for t in e.iter(f"{_W}t")).split())
    n = 0
    for element in body:
        rows = [(None, [element])] if element.tag == f"{_W}p" else [("Table", list(r.iter(f"{_W}tc"))) for r in element.iter(f"{_W}tr")] if element.tag == f"{_W}tbl" else []
        for style, cells in rows:
            parts = [text(c) for c in cells]
            own = " | ".join(p for k, p in enumerate(parts) if p and (k == 0 or p != parts[k - 1]))
            mark = element.find(f"{_W}pPr/{_W}pStyle") if style is None else None
            if own:
                yield n, style or (mark.get(f"{_W}val") if mark is not None else None), own
                n += 1


def read_docx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_per_file(lambda _, c: docx_paragraphs(c), [x.split()[0] for x in PARAGRAPH.split(", ")]), PARAGRAPH)


READERS = {"docx": read_docx}


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Paragraphs of documents, each by the reader of its suffix; a suffix without one is an error."""
    by_suffix: dict[str, list[str]] = {}
    for path in paths:
        suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
        if suffix not in READERS:
            raise ValueError(f"no reader for {suffix!r} ({path}); there are {', '.join(sorted(READERS))}")
        by_suffix.setdefault(suffix, []).append(path)
    out = spark.createDataFrame([], PARAGRAPH)
    for suffix, own in sorted(by_suffix.items()):
        out = out.unionByName(READERS[suffix](spark, own))
    return out


def schema_rows(triples: DataFrame) -> DataFrame:
    """id, label, kind, parents, domain, range from RDFS triples; a label in English or without language, an id from the local name."""
    local = lambda c: F.regexp_extract(c, r"([^/#]+)$", 1)
    ident = lambda c: F.regexp_extract(local(c), r"^([A-Za-z]+\d+i?)", 1)
    pick = lambda p: F.when(F.col("predicate") == p, F.col("object"))
    rows = triples.where("error IS NULL").groupBy("subject").agg(F.min(pick(RDF + "type")).alias("type"), F.min(pick(RDFS + "label")).alias("label"), F.array_sort(F.collect_set(F.coalesce(pick(RDFS + "subClassOf"), pick(RDFS + "subPropertyOf")))).alias("up"), F.min(pick(RDFS + "domain")).alias("d"), F.min(pick(RDFS + "range")).alias("r"))
    kind = F.when(F.col("type").endswith("Class"), "class").when(F.col("type").endswith("Property"), "property")
    return rows.select(ident(F.col("subject")).alias("id"), "label", kind.alias("kind"), F.transform("up", ident).alias("parents"), ident(F.col("d")).alias("domain"), ident(F.col("r")).alias("range"), F.col("subject").alias("uri")).where("kind IS NOT NULL AND id <> ''")
