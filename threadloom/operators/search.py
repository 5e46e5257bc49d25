"""Lexical and dense retrieval, rank fusion, filters and diversity rules.

An index is a table of postings (field, term, id, positions, length) with statistics; stored, it is built once and searched
many times, and a search reads the folders of its terms only. A search takes a batch of queries, so thousands run in one
plan. Every ranking carries an explicit tie-break.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.splitting import folds, places_of
from .dense import Dense
from .lexicon import expanded
from .worktables import global_rank, materialise

# Fixed values of ranking.
RRF_K = 60
POOL_FACTOR = 3
HITS_PER_THREAD = 2
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
MODES = ("hybrid", "bm25", "vector")


@dataclass
class LexicalIndex:
    postings: DataFrame  # field, term, id, positions, length (of the whole row)
    docs: int | None = None  # of a stored index: how many rows it has,
    mean: float | None = None  # their mean length,
    buckets: int = 0  # and the number of folders that terms are dealt to
    lengths: DataFrame | None = None  # id, length of an index that isn't stored
    some: bool = False  # whether it has the postings of some terms only (lengths are of all)


POSTING = T.StructType().add("field", "string").add("term", "string").add("positions", T.ArrayType(T.IntegerType())).add("length", "long")


NAMES = ["field", "term", "id", "positions", "length"]


def _postings(field: str, part: pa.RecordBatch, length: pa.Array, terms: pa.Array, rows: np.ndarray, places: np.ndarray, codes: np.ndarray) -> list[pa.RecordBatch]:
    """Postings of words that stand at `places` of `rows`, in the order of rows and places; a word is a number in `terms`."""
    if not len(codes):
        return []
    keys = rows * len(terms) + codes
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.diff(keys[order], prepend=-1))
    firsts = order[begins]
    at, offsets = pa.array(rows[firsts]), pa.array(np.append(begins, len(order)).astype(np.int32))
    columns = [pa.repeat(field, len(begins)), terms.take(pa.array(codes[firsts])), part["id"].take(at), pa.ListArray.from_arrays(offsets, pa.array(places[order].astype(np.int32))), length.take(at)]
    return pa.table(columns, names=NAMES).to_batches(max_chunksize=100_000)


def _listed(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of lists, and row, place and number of each word."""
    words, sizes = lists.flatten().dictionary_encode(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    rows = np.repeat(np.arange(len(lists)), sizes)
    places = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return words.dictionary, rows, places, words.indices.to_numpy()


def _gathering(fields: list[str], tokens: int = 1_000_000, asked: Sequence[str] | None = None, packed: bytes = b""):
    """id, length and lists of words to postings, in slices of rows with about `tokens` words at most.

    asked: other terms are passed over, and each row's length comes as a row without term. A field then comes as text, or as a list
    where only the engine can split it (functions/splitting.py), and length is a bound of the row's words.
    """

    def whole(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k, field in enumerate(fields):
            terms, rows, places, codes = _listed(part[f"w{k}"])
            yield from _postings(field, part, part["length"], terms, rows, places, codes)

    def some(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        terms, found, sizes = pa.array(asked, pa.string()), [], np.zeros(len(part), np.int64)
        for k in range(len(fields)):
            counts, *met = places_of(pc.fill_null(part[f"t{k}"].cast(pa.string()), ""), asked, packed)
            sizes += counts
            lists = part[f"w{k}"]
            if lists.null_count < len(lists):
                words, rows, places, codes = _listed(lists)
                sizes += np.bincount(rows, minlength=len(part))
                number = pc.fill_null(pc.index_in(words, value_set=terms.cast(words.type)), -1).to_numpy()[codes].astype(np.int64)
                met = [np.append(a, b[number >= 0]) for a, b in zip(met, (rows, places, number), strict=True)]
            found.append(met)
        length, empty = pa.array(sizes), [pa.nulls(len(part), kind) for kind in (pa.string(), pa.string(), pa.list_(pa.int32()))]
        yield from pa.table([empty[0], empty[1], part["id"], empty[2], length], names=NAMES).to_batches(max_chunksize=100_000)
        for field, met in zip(fields, found, strict=True):
            yield from _postings(field, part, length, terms, *met)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = np.flatnonzero(np.diff(np.cumsum(batch["length"].to_numpy()) // tokens)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                yield from (whole if asked is None else some)(batch.slice(low, high - low))

    return gather


def build_index(docs: DataFrame, id_col: str, fields: Sequence[str], keys_unique: bool = False, terms: Sequence[str] | None = None) -> LexicalIndex:
    """Index some columns; the first row of an id counts (keys_unique: there is only one).

    A row's positions are gathered by term within the row, some rows at a time, so nothing is exchanged.
    terms: what will be asked. Every text is split whole for its length and for these terms, but other postings are left out and
    other words don't become strings; what is found is written to a work table, so texts are read once.
    """
    rows = docs if keys_unique else first_of_each(docs, id_col, F.monotonically_increasing_id())
    texts = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields}
    sum_of = lambda sizes: sum(sizes, start=F.lit(0).cast("long"))
    kind = lambda own: T.StructType([*POSTING.fields[:2], T.StructField("id", own.schema["id"].dataType), *POSTING.fields[2:]])
    if terms is not None:
        split = folds(docs.sparkSession)
        plain = {f: reduce(lambda a, c: a & ~F.contains(texts[f], F.lit(c)), split.odd, F.is_valid_utf8(texts[f])) for f in fields}
        own = rows.select(F.col(id_col).alias("id"), sum_of(F.octet_length(t) for t in texts.values()).alias("length"), *[c for k, f in enumerate(fields) for c in (F.when(plain[f], texts[f]).alias(f"t{k}"), F.when(~plain[f], X.tokens(texts[f])).alias(f"w{k}"))])
        found = materialise(own.mapInArrow(_gathering(list(fields), asked=sorted(set(terms)), packed=split.packed), kind(own)), "asked")
        return LexicalIndex(found.where("term IS NOT NULL"), lengths=found.where("term IS NULL").select("id", "length"), some=True)
    own = rows.select(F.col(id_col).alias("id"), *[X.tokens(t).alias(f"w{k}") for k, t in enumerate(texts.values())])
    length = sum_of(F.size(f"w{k}") for k in range(len(texts)))
    postings = own.select("id", length.alias("length"), *[f"w{k}" for k in range(len(texts))]).mapInArrow(_gathering(list(fields)), kind(own))
    return LexicalIndex(postings, lengths=own.select("id", length.alias("length")))


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(index: LexicalIndex, path: str, buckets: int = 64, parts: int = 8) -> int:
    """Store an index: postings in folders by term, sorted, and one row of statistics. Replaces what was there; gives the number of rows indexed.

    A term's postings are dealt to several files, so a frequent term gathers nowhere. Counts are checked against what is read again.
    """
    from ..sources.files import write_counted

    keyed = index.postings.withColumn("bucket", bucket_of("term", buckets)).repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(parts)))
    keyed.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    if index.some:
        stored = index.lengths.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    else:
        stored = index.postings.sparkSession.read.schema(keyed.schema).parquet(f"{path}/postings").agg(F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("tokens"))
    counts = index.lengths.select("id").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("id").alias("ids"))  # no text is read for them
    write_counted(counts.crossJoin(stored).select("docs", F.try_divide("tokens", "docs").alias("mean"), "ids", F.lit(buckets).alias("buckets"), F.lit(keyed.schema.json()).alias("schema")), f"{path}/stats")
    row = index.postings.sparkSession.read.parquet(f"{path}/stats").first()
    if row["docs"] != row["ids"]:
        raise RuntimeError(f"{row['docs']} rows of {row['ids']} ids")
    return row["docs"]


def read_index(spark: SparkSession, path: str) -> LexicalIndex:
    """A stored index: a search reads the folders of its terms only."""
    row = spark.read.parquet(f"{path}/stats").first()
    kinds = T.StructType.fromJson(json.loads(row["schema"]))  # folders without a posting tell none
    return LexicalIndex(spark.read.schema(kinds).parquet(f"{path}/postings"), row["docs"], row["mean"], row["buckets"])


def _asked(index: LexicalIndex, phrases: DataFrame) -> DataFrame:
    """The postings that a batch of queries needs."""
    if not index.buckets:
        return index.postings
    wanted = [r["b"] for r in phrases.select(F.explode("terms").alias("term")).select(bucket_of("term", index.buckets).alias("b")).distinct().collect()]  # as many as folders at most
    return index.postings.where(F.col("bucket").isin(wanted))


def first_of_each(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of every key in the given order (dropDuplicates keeps an arbitrary one)."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def occurrences(index: LexicalIndex, phrases: DataFrame) -> DataFrame:
    """query, phrase, id, field, n for phrases (query, phrase, terms): places where all terms stand in a row."""
    parts = phrases.select("query", "phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
    met = parts.join(_asked(index, phrases), "term")
    single = met.where("size = 1").select("query", "phrase", "id", "field", "length", F.size("positions").alias("n"))
    if phrases.where(F.size("terms") > 1).isEmpty():
        return single
    starts = met.where("size > 1").select("query", "phrase", "size", "id", "field", "length", F.transform("positions", lambda p: p - F.col("at")).alias("starts"))
    whole = starts.groupBy("query", "phrase", "size", "id", "field", "length").agg(F.collect_list("starts").alias("s")).where(F.size("s") == F.col("size"))
    common = F.aggregate(F.slice("s", F.lit(2), F.col("size") - 1), F.get("s", 0), lambda found, s: F.array_intersect(found, s))
    return single.unionByName(whole.select("query", "phrase", "id", "field", "length", F.size(common).alias("n")).where("n > 0"))


def bm25(index: LexicalIndex, phrases: DataFrame, weights: dict[str, float]) -> DataFrame:
    """query, id, score: any phrase may match; a field's weight scales its frequency, and weight 0 still counts as a match."""
    found = occurrences(index, phrases)
    weight = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, float(w))])
    frequency = found.groupBy("query", "phrase", "id", "length").agg(F.sum(weight[F.col("field")] * F.col("n")).alias("f"))
    rows = frequency.groupBy("query", "phrase").agg(F.count(F.lit(1)).alias("n"))
    joined = frequency.join(rows, ["query", "phrase"])
    if index.buckets:
        joined = joined.withColumns({"docs": F.lit(index.docs), "mean": F.lit(index.mean)})
    else:
        joined = joined.crossJoin(F.broadcast(index.lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))))  # one row
    plain = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(plain <= 0, F.lit(LEAST_IDF)).otherwise(plain)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.groupBy("query", "id").agg(F.sum(part).alias("score"))


def phrases_of(queries: DataFrame) -> DataFrame:
    """query, phrase, terms from (query, text): every blank-parted word is a phrase of its own tokens."""
    words = queries.select("query", F.posexplode(F.split(X.collapsed("text"), " ")).alias("phrase", "word"))
    once = words.select("query", "phrase", X.tokens("word").alias("terms")).where(F.size("terms") > 0)
    return once.groupBy("query", "terms").agg(F.min("phrase").alias("phrase"))


def terms_of(phrases: DataFrame) -> DataFrame:
    return phrases.select(F.explode("terms").alias("term")).distinct()


def write_vectors(vectors: DataFrame, id_col: str, vector_col: str, path: str) -> int:
    """Store vectors at unit length, replacing what was there; the number of rows is checked against what is read again."""
    from ..sources.files import write_counted

    return write_counted(vectors.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("vector")), path)


def unit(vector: Column) -> Column:
    """The vector over its norm, which is bound by a lambda: as a plain expression it would be summed again for every element."""
    own = F.transform(vector, lambda x: x.cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    both = F.transform(F.array(own), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return F.get(F.transform(both, lambda b: F.transform(b["v"], lambda x: x / b["n"])), F.lit(0))


def cosine(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, block: int = 10_000) -> DataFrame:
    """query, id, score of query vectors (query, vector) against all vectors: each is brought to unit length once, and the queries
    are broadcast in blocks of about `block`."""
    own = vectors.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("own"))
    asked, blocks, out = queries.select("query", unit(F.col("vector")).alias("vector")), max(1, -(-queries.count() // block)), None
    dot = F.aggregate(F.zip_with("own", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        found = own.join(F.broadcast(part)).select("query", "id", dot.alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


def ranked(scores: DataFrame, most: int, list_no: int = 0, digits: int = 6) -> DataFrame:
    """query, id, rank, score, list: the best `most` of each query; scores that agree to `digits` places are tied by id."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    out = scores.select("query", "id", F.round("score", digits).alias("score")).withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= most).withColumn("list", F.lit(list_no))


def ranked_all(scores: DataFrame, list_no: int = 0, digits: int = 6) -> DataFrame:
    """The same for every row of a query, by ranges of scores: no task orders a whole query."""
    rounded = scores.select("query", "id", F.round("score", digits).alias("score"))
    placed = global_rank(rounded, "__place", "query", F.desc("score"), "id")
    first = placed.groupBy("query").agg(F.min("__place").alias("__first"))
    return placed.join(first, "query").select("query", "id", "score", (F.col("__place") - F.col("__first") + 1).cast("int").alias("rank"), F.lit(list_no).alias("list"))


def fuse(rankings: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int = RRF_K) -> DataFrame:
    """query, id, score: sum of weight / (k + rank), and where the id came up first, to tie by."""
    weights = list(weights) if weights is not None else [1.0] * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError(f"{len(weights)} weights for {len(rankings)} rankings")
    every = None
    for n, (ranking, weight) in enumerate(zip(rankings, weights, strict=True)):
        own = ranking.select("query", "id", "rank", F.lit(n).alias("list"), F.lit(float(weight)).alias("weight"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("query", "id").agg(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))


def dense_weight(text: str) -> float:
    """Even fusion if the query names an identifier, else the dense list counts twice."""
    import re

    return 1.0 if re.search(X.IDENTIFIER, text, re.I) else 2.0


def filtered(hits: DataFrame, author: str | None = None, after: int | None = None, before: int | None = None, entity: str | None = None) -> DataFrame:
    """Filters of a search; they come after ranking, so ranks don't depend on them. An undated row is of year 0."""
    if author is not None:
        hits = hits.where(F.contains(F.lower(F.coalesce("author", F.lit(""))), F.lit(author.lower())))
    if after is not None:
        hits = hits.where(X.year_of("date") >= after)
    if before is not None:
        hits = hits.where(X.year_of("date") <= before)
    return hits if entity is None else hits.where(F.array_contains("entities", entity))


def diverse(hits: DataFrame, most: int, per_thread: int = HITS_PER_THREAD) -> DataFrame:
    """One hit per message, then at most `per_thread` per thread (an empty thread is exempt), then the best `most`.

    hits: query, message, thread and place (1, 2, ... in fused order).
    """
    first = Window.partitionBy("query", "message").orderBy("place")
    in_thread = Window.partitionBy("query", "thread").orderBy("place")
    final = Window.partitionBy("query").orderBy("place")
    once = hits.withColumn("__m", F.row_number().over(first)).where("__m = 1")
    capped = once.withColumn("__t", F.row_number().over(in_thread)).where((F.col("__t") <= per_thread) | (F.col("thread") == ""))
    return capped.withColumn("position", F.row_number().over(final)).where(F.col("position") <= most).drop("__m", "__t")


def hybrid(lexical: DataFrame | None, dense: DataFrame | Dense | None, records: DataFrame, most: int, weights: tuple[float, float] = (1.0, 1.0), mode: str = "hybrid", per_thread: int | None = HITS_PER_THREAD, keep=lambda hits: hits, store_size: int | None = None) -> DataFrame:
    """Fused search: rank, fuse, read records, filter, diversify. records: id, message, thread and whatever `keep` needs.

    The pool of each list is POOL_FACTOR * most; while a query gets fewer than `most` hits and the pool is smaller than the
    store, it doubles. Both rankings are computed once to the widest pool, so widening is a filter on rank. With vectors as
    Dense the whole store is tried first: what is short of hits there is short in every smaller pool.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    lists = [(x, w) for x, w, m in ((lexical, weights[0], "bm25"), (dense, weights[1], "vector")) if x is not None and mode in ("hybrid", m)]
    pool, queries = POOL_FACTOR * most, 0
    if store_size and any(isinstance(x, Dense) for x, _ in lists):
        whole = materialise(_whole_store(lists, records, most, per_thread, keep), "hits")
        queries = whole.select("query").distinct().count()
        if pool >= store_size or starved(whole, most):
            return whole
    place = lambda x, n: ranked(x.top(n), n) if isinstance(x, Dense) else ranked(x, n)
    rankings = [x if isinstance(x, Dense) else materialise(ranked_all(x), "ranks") if store_size else ranked(x, pool) for x, _ in lists]
    while True:
        fused = fuse([place(r, pool) if isinstance(r, Dense) else r.where(F.col("rank") <= pool) for r in rankings], [w for _, w in lists])
        hits = keep(_placed(fused).join(records, "id"))
        out = _best_hits(hits, most, per_thread)
        if not store_size or pool >= store_size or not starved(out, most, queries):
            return out
        pool = min(2 * pool, store_size)


def _placed(fused: DataFrame) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "first", "id")
    return fused.withColumn("place", F.row_number().over(order))


def _best_hits(hits: DataFrame, most: int, per_thread: int | None) -> DataFrame:
    return diverse(hits, most, per_thread) if per_thread else hits.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("place"))).where(F.col("position") <= most)


def _whole_store(lists: list, records: DataFrame, most: int, per_thread: int | None, keep) -> DataFrame:
    """hybrid over the whole store without ranking every pair: kept records are candidates where words find them or where they are
    among the best of their thread by vector, and only candidates' ranks are counted. `keep` reads records' columns; a message
    has one thread. `place` counts candidates."""
    kept = materialise(keep(records), "kept")
    shared = kept.groupBy("message").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    words = {n: materialise(ranked_all(x), "ranks").join(kept.select("id").distinct(), "id", "left_semi") for n, (x, _) in enumerate(lists) if not isinstance(x, Dense)}
    rankings = dict(words)
    for n, (x, _) in enumerate(lists):
        if isinstance(x, Dense):
            of_id = kept.groupBy("id").agg(F.min("thread" if per_thread else F.lit("")).alias("part"))
            found = x.top_in(of_id, ((per_thread or 1) - 1) * shared + 1, (most - 1) * (shared if per_thread else 1) + 1)
            for w in words.values():
                found = found.unionByName(x.scored(w))
            rankings[n] = materialise(x.ranks(materialise(found.distinct(), "scores")), "ranks")
    fused = fuse([rankings[n] for n in range(len(lists))], [w for _, w in lists])
    return _best_hits(_placed(fused).join(kept, "id"), most, per_thread)


def of_kinds(records: DataFrame, kinds: str | Sequence[str] | None, default: Sequence[str], known: Sequence[str]) -> DataFrame:
    """Records of some kinds (None: the default ones); an unknown kind is an error that tells the known ones."""
    wanted = list(default) if kinds is None else [kinds] if isinstance(kinds, str) else list(kinds)
    if wrong := sorted(set(wanted) - set(known)):
        raise ValueError(f"unknown kind {', '.join(wrong)}; there are {', '.join(sorted(known))}")
    return records.where(F.col("kind").isin(wanted))


def search(
    queries: DataFrame, index: LexicalIndex | None, vectors: DataFrame | None, records: DataFrame, most: int = 10, mode: str = "hybrid", names: DataFrame | None = None, stops: Sequence[str] = (),
    author: str | None = None, after: int | None = None, before: int | None = None, entity: str | None = None, weights: dict[str, float] | None = None, per_thread: int | None = HITS_PER_THREAD, widen: bool = True,
) -> DataFrame:
    """query, id, position, score, and the records' columns for a batch of queries (query, text, vector): the whole search.

    names (id, label) widens the words by what the query names; an entity that is filtered on is searched for too. A query that names
    an identifier weighs both lists alike, others the dense one twice. Filters come after ranking and widen the pool up to the
    store. records: id, message, thread, author, date, entities and what else is asked for.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    text = queries.select("query", "text")
    if names is not None:
        more = expanded(text, names, list(stops)).select("query", "terms")
        text = text.join(more, "query").select("query", F.concat_ws(" ", "text", F.nullif(F.replace("terms", F.lit(","), F.lit(" ")), F.lit(""))).alias("text"))
    if entity is not None:
        text = text.select("query", F.concat_ws(" ", "text", F.lit(entity)).alias("text"))
    lexical = bm25(index, phrases_of(text), weights or {"text": 1.0}) if index is not None and mode != "vector" else None
    dense = Dense(vectors, queries.select("query", "vector"), "id", "vector") if vectors is not None and mode != "bm25" else None
    names_one = queries.select("query", F.col("text").rlike(f"(?i){X.IDENTIFIER}").alias("exact"))
    asked = any(x is not None for x in (author, after, before, entity))
    size = (max(index.docs or 0, records.count()) if index is not None else records.count()) if asked and widen else None
    out = None
    for exact in (True, False):  # the two ways to weigh the lists; every query goes one of them
        own = names_one.where(F.col("exact") if exact else ~F.col("exact")).select("query")
        one = None if lexical is None else lexical.join(own, "query", "left_semi")
        two = None if dense is None else Dense(vectors, dense.queries.join(own, "query", "left_semi"), "id", "vector")
        found = hybrid(one, two, records, most, (1.0, 1.0 if exact else 2.0), mode, per_thread, lambda h: filtered(h, author, after, before, entity), size)
        out = found if out is None else out.unionByName(found)
    return out


def starved(out: DataFrame, most: int, queries: int = 0) -> bool:
    """Whether some query got fewer than `most` hits (or none at all did, or fewer than `queries` did)."""
    least, n = out.groupBy("query").count().agg(F.min("count"), F.count(F.lit(1))).first()
    return least is None or least < most or n < queries


def promoted(fused: DataFrame, declarations: DataFrame) -> DataFrame:
    """Declarations that a query names come before the fused order, with score 0 where they weren't fused."""
    named = declarations.select("query", "id").distinct().withColumn("named", F.lit(0))
    both = fused.join(named, ["query", "id"], "full_outer")
    return both.select("query", "id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("named", F.lit(1)).alias("named"), "first")
