"""JSON, Parquet, registers, cached pages, archives of mail, and sinks with checks."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mail import MESSAGE, html_rows_udf, parse_message_udf


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, in any file system that Spark reads, matches something."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "json", **options) -> DataFrame:
    """A source of a known schema; what isn't there reads as no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).format(kind).load(path)


def read_matching(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON files of a pattern; a pattern that matches nothing is an error."""
    if not exists(spark, pattern):
        raise FileNotFoundError(f"nothing matches {pattern}")
    return spark.read.option("multiLine", True).json(pattern)


def read_register(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows with whole-number ids; others are left out."""
    return read_or_empty(spark, path, schema).withColumn("id", F.col("id").try_cast("int")).where("id IS NOT NULL")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """id, html of {id}.html; other names are ignored."""
    raw = read_or_empty(spark, f"{folder}/*.html", "value string", "text", wholetext="true")
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)\.html$", 1).try_cast("int").alias("id"), F.col("value").alias("html")).where("id IS NOT NULL") if "value" in raw.columns and exists(spark, f"{folder}/*.html") else spark.createDataFrame([], "id int, html string")


def register_rows(pages: DataFrame, html: str, columns: dict[str, int], id_pattern: str = r"(\d+)") -> DataFrame:
    """id, href, and the named cells (name -> place in a row) of every table row of the pages whose first cell holds a number."""
    rows = pages.select(F.explode(html_rows_udf(html)).alias("r"))
    ident = F.regexp_extract(F.get("r", 0)["text"], id_pattern, 1).try_cast("int")
    link = F.get(F.filter(F.transform("r", lambda c: c["href"]), lambda h: h.isNotNull()), 0)
    return rows.select(ident.alias("id"), link.alias("href"), *[F.get("r", k)["text"].alias(name) for name, k in columns.items()]).where("id IS NOT NULL")


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mbox files, parsed in the workers; a file is split at its `From ` lines, so large archives are read in parallel."""
    raw = spark.read.option("lineSep", "\nFrom ").text(path).where(F.trim("value") != "")
    body = F.regexp_replace(F.regexp_replace("value", r"^(?:From )?[^\n]*\n", ""), r"(?m)^>(>*From )", "$1")
    parsed = raw.select(parse_message_udf(F.encode(body, "UTF-8")).alias("m")).select("m.*")
    return parsed.select(*[F.col(f"`{c}`") for c in MESSAGE.names])


@dataclass
class Archive:
    """Settings of one archive; what isn't given has these defaults."""

    name: str
    description: str = ""
    chunk_size: int = 2000
    chunk_overlap: int = 200
    footer_marker: str = "mailing list"
    id_pattern: str = r"\b([EP]\d{1,3})(?:\.\d)?i?\b"
    stop_labels: list[str] = field(default_factory=list)
    min_thread_size: int = 2


def load_archive(path: str, name: str) -> Archive:
    """An archive of a YAML or JSON registry; an unknown name says which there are."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        registry = json.loads(text)
    else:
        import yaml

        registry = yaml.safe_load(text)
    if name not in registry:
        raise KeyError(f"unknown archive {name!r}; there are {', '.join(sorted(registry))}")
    known = {f.name for f in fields(Archive)}
    return Archive(name=name, **{k: v for k, v in (registry[name] or {}).items() if k in known - {"name"}})


def write_counted(df: DataFrame, path: str, kind: str = "parquet") -> int:
    """Overwrite a table and count what was written against what is read again; a difference is an error."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").format(kind).save(path)
    there = df.sparkSession.read.format(kind).schema(df.schema).load(path).count()
    if there != seen.get["n"]:
        raise RuntimeError(f"{path} has {there} rows of {seen.get['n']}")
    return there


def write_metadata(path: str, name: str, sources: DataFrame, **more) -> dict:
    """Store metadata with a digest over all inputs (path, content), whatever their order."""
    parts = sources.select("path", F.sha2("content", 256).alias("sha256")).orderBy("path").collect()  # one row a source file
    whole = hashlib.sha256("".join(f"{r['path']}:{r['sha256']}\n" for r in parts).encode()).hexdigest()
    meta = {"name": name, "source_sha256": whole, "sources": len(parts), **more}
    Path(path).write_text(json.dumps(meta, indent=2, sort_keys=True), encoding="utf-8")
    return meta


def provenance(metas: list[dict]) -> str:
    """One digest of several stores' metadata."""
    return hashlib.sha256("\n".join(json.dumps(m, sort_keys=True) for m in sorted(metas, key=lambda m: m["name"])).encode()).hexdigest()
