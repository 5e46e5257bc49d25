"""Language identification by interpolated Kneser-Ney character models.

Words of a bounded sample of labelled documents (TRAIN_DOCS whole documents a language, MOST_LANGUAGES languages) give the
counts of character n-grams up to ORDER within words; their begin and end are symbols too. All languages share one sorted
array of n-gram hashes and one of context hashes, beside matrices of discounted probabilities and interpolation weights, so
one binary search serves every language. A document goes to the language with the least cross-entropy per symbol.

Rejection is calibrated by cross-fitting: each half of the sample is scored by models of the other half. That gives, for each
language, the usual cross-entropy, how far documents stray from it and how far their words do, so that short texts have more
room; languages with few rows lean on all languages' rows, so none is without a bound. The limit on the standardised distance is
where an exponential tail, fitted to the largest twentieth of the calibration rows, leaves FALSE_REJECTIONS of the texts of known
languages. The same rows give how fast confidence grows with the lead over other languages. A rejected text keeps its
nearest language as prediction, with a score that falls to zero beyond the limit.

Words are scored once for each chunk of input, so cost follows distinct words; very long texts are scored whole.

Defined cases: null text and text without letters are `und` with score 0 and rejected; languages that tie are taken in
alphabetical order; rows with null doc_id train and are not held out; without any labelled row, and so with an empty table to
learn from, everything is `und`; an empty table gives an empty result; rows with null lang don't train; repeated rows count
each; further columns, whatever their names, are kept by drop_rejected and not read otherwise.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, crc_remainder, materialise, quoted, row_type, texts_of, to_arrow_schema, whole_row

ORDER = 5
TRAIN_DOCS = 1500  # labelled documents a language that the models are fitted on (expected number of a hashed sample)
BEGIN, END = "\x02", "\x03"
MOST_LANGUAGES = 256  # the most frequent labels that are learnt
UND = "und"
FALSE_REJECTIONS = 1e-4  # share of texts of known languages beyond the limit of rejection
TAIL = 0.05  # share of the calibration rows that the tail is fitted to
PRIOR_ROWS = 20  # weight of all languages' rows beside a language's own
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def raw_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of a-z and non-ASCII characters."""
    return text.decode().lower().encode().translate(_WORD).split()


def letters(word: bytes) -> str:
    own = word.decode()
    return own if own.isalpha() else "".join(filter(str.isalpha, own))


class Grams:
    """Hashes of all n-grams of some words. grams(n): positions where an n-gram ends, its hash, its context's hash."""

    def __init__(self, words: list[str]):
        text = "".join([BEGIN + w + END for w in words])
        self.codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.word = np.repeat(np.arange(len(words)), sizes)
        self.place = np.arange(len(self.codes)) - self.starts[self.word] if len(words) else np.zeros(0, np.int64)

    def orders(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        before = np.ones(len(self.codes), np.uint64)  # hash of the n-1 symbols that end here, for n = 1: of none
        for n in range(1, most + 1):
            context = before if n == 1 else np.concatenate([before[:1], before[:-1]])
            own = context * _FACTOR + self.codes + np.uint64(n)
            at = np.flatnonzero((self.place >= max(1, n - 1)))
            yield n, at, own[at], context[at]
            before = own


class Models:
    """Kneser-Ney models of several languages in sorted hash arrays."""

    def __init__(self, counts: dict[str, Counter], order: int = ORDER):
        self.languages, self.order = sorted(counts), order
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        symbols: set[str] = set()
        for own in counts.values():
            symbols.update(chain.from_iterable(own))
        self.floor = 1.0 / (len(symbols) + 2)
        for lang in self.languages:
            found.append(self._train(list(counts[lang]), np.array(list(counts[lang].values()), np.float64)))
        self.grams, self.alpha = self._merge([(g, a) for g, a, _, _ in found], 0.0)
        self.contexts, self.weight = self._merge([(c, w) for _, _, c, w in found], 1.0)
        n = len(self.languages)
        self.most = -np.log2(self.floor)  # bits of a symbol that nothing is known about: no text may cost more
        self.mean, self.between, self.symbol = np.full(n, self.most), np.zeros(n), np.ones(n)
        self.limit, self.tail, self.sharpness = 0.0, 1.0, 10.0

    def _train(self, words: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = Grams(words)
        levels = []
        for n, at, gram, context in own.orders(self.order):
            names, first, of = np.unique(gram, return_index=True, return_inverse=True)
            levels.append((n, names, context[first], np.bincount(of, times[own.word[at]]), at[first], own.place[at[first]] == n - 1))
        grams, alphas, contexts, weights = [], [], [], []
        for k, (_n, names, context, raw, _at, at_begin) in enumerate(levels):
            count = raw
            if k + 1 < len(levels):  # how many different symbols stand before the n-gram; at a word's begin none can
                longer_at = levels[k + 1][4]
                suffix = self._hash_at(own, longer_at, k + 1)
                different = np.bincount(np.searchsorted(names, suffix), minlength=len(names)).astype(np.float64)
                count = np.where(at_begin | (different == 0), raw, different)
            ones, twos = float((count == 1).sum()), float((count == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            heads, of = np.unique(context, return_inverse=True)
            total = np.bincount(of, count)
            kinds = np.bincount(of)
            grams.append(names)
            alphas.append((count - discount) / total[of])
            contexts.append(heads)
            weights.append(discount * kinds / total)
        return np.concatenate(grams), np.concatenate(alphas), np.concatenate(contexts), np.concatenate(weights)

    def _hash_at(self, own: Grams, at: np.ndarray, n: int) -> np.ndarray:
        h = np.ones(len(at), np.uint64)
        for j in range(n):
            h = h * _FACTOR + own.codes[at - (n - 1 - j)] + np.uint64(j + 1)
        return h

    def _merge(self, parts: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        names = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint64)
        table = np.full((len(names) + 1, len(parts)), missing, np.float32)  # the last row stands for what isn't there
        for k, (own, value) in enumerate(parts):
            table[np.searchsorted(names, own), k] = value
        return names, table

    @staticmethod
    def _rows(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(names, wanted)
        at[at == len(names)] = 0
        return np.where(names[at] == wanted, at, len(names)) if len(names) else np.zeros(len(wanted), np.int64)

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word in each language, and its number of symbols (0 for an empty word)."""
        out, symbols = np.zeros((len(words), len(self.languages))), np.zeros(len(words), np.int64)
        full = [i for i, w in enumerate(words) if w]
        if not full or not self.languages:
            return out, symbols
        own = Grams([words[i] for i in full])
        p = np.full((len(own.codes), len(self.languages)), self.floor, np.float32)
        for _, at, gram, context in own.orders(self.order):
            p[at] = self.alpha[self._rows(self.grams, gram)] + self.weight[self._rows(self.contexts, context)] * p[at]
        bits = -np.log2(p)
        bits[own.starts] = 0
        out[full] = np.add.reduceat(bits, own.starts, axis=0)
        symbols[full] = own.ends - own.starts - 1
        return out, symbols

    def documents(self, texts: list[bytes], spread: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Cross-entropy per symbol of each text in each language, its number of symbols, and (spread) a symbol's variance as its words tell."""
        lists = [raw_words(t) for t in texts]
        code: defaultdict[bytes, int] = defaultdict()
        code.default_factory = code.__len__
        lengths = np.array([len(x) for x in lists], np.int64)
        codes = np.fromiter(map(code.__getitem__, chain.from_iterable(lists)), np.int64, int(lengths.sum()))
        names = list(code)
        parts = [self.costs([letters(w) for w in names[at : at + 20_000]]) for at in range(0, len(names), 20_000)]
        total, symbols = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        variance = np.zeros_like(total) if spread else None
        full = np.flatnonzero(lengths)
        if len(full):
            bits, sizes = np.concatenate([p[0] for p in parts]).astype(np.float64), np.concatenate([p[1] for p in parts])
            starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
            own = sizes[codes]
            symbols[full] = np.add.reduceat(own, starts)
            for k in range(len(self.languages)):
                cost = bits[:, k][codes]
                total[full, k] = np.add.reduceat(cost, starts)
                if spread:
                    mean = total[full, k] / np.maximum(symbols[full], 1)
                    variance[full, k] = np.add.reduceat((cost - np.repeat(mean, lengths[full]) * own) ** 2, starts) / np.maximum(symbols[full], 1)
        return total / np.maximum(symbols, 1)[:, None], symbols, variance

    def distance(self, language: np.ndarray, cross: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """How far texts are from what is usual for a language, in standard deviations for their length."""
        return (cross - self.mean[language]) / np.sqrt(self.between[language] + self.symbol[language] / np.maximum(symbols, 1))

    def calibrate(self, own: np.ndarray, cross: np.ndarray, symbols: np.ndarray, variance: np.ndarray) -> None:
        """From held-out rows: their language, cross-entropies in all languages (infinite where a half has no model), length, a symbol's variance."""
        mine = cross[np.arange(len(own)), own]
        ok = (symbols > 0) & np.isfinite(mine)
        own, cross, symbols, variance, mine = own[ok], cross[ok], symbols[ok], variance[ok], mine[ok]
        if not len(own):
            return
        n = np.bincount(own, minlength=len(self.languages))
        add = lambda x: np.bincount(own, x, len(self.languages))
        self.mean = (add(mine) + PRIOR_ROWS * mine.mean()) / (n + PRIOR_ROWS)
        self.symbol = (add(variance) + PRIOR_ROWS * variance.mean()) / (n + PRIOR_ROWS)
        noise = self.symbol[own] / symbols
        near = (mine - self.mean[own]) ** 2 - noise
        lean = max(float(near.mean()), 0.0) + 1e-4
        self.between = np.maximum(add(near) + PRIOR_ROWS * lean, 0) / (n + PRIOR_ROWS) + (mine.mean() - self.mean) ** 2 * PRIOR_ROWS / (n + PRIOR_ROWS) + 1e-4
        z = np.sort(self.distance(own, mine, symbols))
        top = z[-max(1, int(TAIL * len(z))) :]
        self.tail = float(((top - top[0]).sum() + 1.0) / len(top))
        self.limit = max(float(top[0]), 1.0) + self.tail * float(np.log(len(top) / len(z) / FALSE_REJECTIONS))
        lead = cross - mine[:, None]
        costs = [(np.log(np.exp(np.clip(-s * lead, -700, 700)).sum(axis=1)).sum(), s) for s in (1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0, 30.0)]
        self.sharpness = min(costs)[1]  # under which the rows' languages are likeliest

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether the text is rejected."""
        cross, symbols, _ = self.documents(texts)
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = cross.argmin(axis=1)
        least = cross[np.arange(len(texts)), best]
        beyond = np.maximum(self.distance(best, least, symbols) - self.limit, 0)
        rejected = (symbols == 0) | (beyond > 0) | (least > self.most)
        likely = 1 / np.exp(np.maximum(-self.sharpness * (cross - least[:, None]), -700)).sum(axis=1)
        score = np.where(symbols > 0, likely * np.exp(-np.minimum(beyond / self.tail, 700)), 0.0)
        return [self.languages[b] if n else UND for b, n in zip(best.tolist(), symbols.tolist(), strict=True)], score, least, rejected


def _word_counts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        counts: dict[tuple[str, int], Counter] = {}
        for lang, half, text in zip(batch.column("lang").to_pylist(), batch.column("half").to_pylist(), texts_of(batch.column("text")), strict=True):
            counts.setdefault((lang, half), Counter()).update(map(letters, raw_words(text)))
        rows = [(*key, w, n) for key, own in counts.items() for w, n in own.items() if w]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _cross_fit(batches: Iterator[pa.RecordBatch], schema: pa.Schema, languages: list[str], halves: list[Models]) -> Iterator[pa.RecordBatch]:
    """Rows of each half by the models of the other one."""
    for batch in chunks(batches):
        for half, models in enumerate(reversed(halves)):
            part = batch.filter(pa.array(np.array(batch.column("half").to_pylist()) == half))
            if part.num_rows:
                found, symbols, variance = models.documents(texts_of(part.column("text")), spread=True)
                cross = np.full((part.num_rows, len(languages)), np.inf)
                at = [languages.index(x) for x in models.languages]
                cross[:, at] = found
                all_variance = np.zeros_like(cross)
                all_variance[:, at] = variance
                own = np.array([languages.index(x) for x in part.column("lang").to_pylist()])
                columns = [own, list(cross), symbols, all_variance[np.arange(len(own)), own]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, order: int = ORDER, most_languages: int = MOST_LANGUAGES) -> Models:
    """Models from the documents whose crc32 of doc_id leaves no remainder 2 by 4."""
    usable = docs.where((crc_remainder(quoted(id_col), 4) != 2) & F.col(quoted(lang_col)).isNotNull() & F.col(quoted(text_col)).isNotNull())
    usable = usable.select(F.col(quoted(lang_col)).alias("lang"), F.col(quoted(text_col)).alias("text"), F.xxhash64(quoted(id_col)).alias("h"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    chance = F.pmod("h", F.lit(1_000_000)) / 1_000_000.0
    sample = usable.join(F.broadcast(sizes), "lang").where(chance < train_docs / F.col("n"))  # most_languages rows at most are broadcast
    sample = materialise(sample.select("lang", "text", F.pmod(F.shiftright("h", 24), F.lit(2)).cast("int").alias("half")), "languages")
    out = T.StructType().add("lang", "string").add("half", "integer").add("word", "string").add("n", "long")
    schema = to_arrow_schema(out)
    words = sample.mapInArrow(lambda it: _word_counts(it, schema), out).groupBy("lang", "half", "word").agg(F.sum("n").alias("n")).orderBy("lang", "half", "word")
    counts: list[dict[str, Counter]] = [{}, {}, {}]
    for r in words.toArrow().to_pylist():  # bounded by the sample
        for own in (counts[r["half"]], counts[2]):
            own.setdefault(r["lang"], Counter())[r["word"]] += r["n"]
    *halves, models = (Models(own, order) for own in counts)
    if models.languages:
        given, measured = docs.sparkSession.sparkContext.broadcast(halves), T.StructType().add("own", "integer").add("cross", T.ArrayType(T.DoubleType())).add("symbols", "long").add("variance", "double")
        measured_schema, languages = to_arrow_schema(measured), models.languages
        known = sample.where(F.col("lang").isin(languages))  # a label may stand on texts without letters only
        found = known.mapInArrow(lambda it: _cross_fit(it, measured_schema, languages, given.value), measured).collect()
        rows = sorted(found, key=lambda r: (r["own"], r["symbols"], r["cross"]))  # bounded by the sample; sums do not depend on how rows came
        models.calibrate(np.array([r["own"] for r in rows], np.int64), np.array([r["cross"] for r in rows]).reshape(-1, len(languages)), np.array([r["symbols"] for r in rows]), np.array([r["variance"] for r in rows]))
    return models


OUT = T.StructType().add("doc_id", "long").add("held_out", "boolean").add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("rejected", "boolean")


def _predict(batches: Iterator[pa.RecordBatch], schema: pa.Schema, models: Models) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        lang, score, cross, rejected = models.predict(texts_of(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(cross), pa.array(rejected)], schema=schema)


def identify(docs: DataFrame, models: Models, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    given, schema = docs.sparkSession.sparkContext.broadcast(models), to_arrow_schema(OUT)
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), (crc_remainder(quoted(id_col), 4) == 2).alias("held_out"), F.col(quoted(text_col)).alias("text"))
    return slim.mapInArrow(lambda it: _predict(it, schema, given.value), OUT)


def _accept(batches: Iterator[pa.RecordBatch], text: str, models: Models) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        rejected = models.predict(texts_of(batch.column("payload").field(text)))[3]
        yield batch.filter(pa.array(~rejected))


def drop_rejected(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The documents that a language is accepted for, with all their columns."""
    given, out = docs.sparkSession.sparkContext.broadcast(models), T.StructType().add("payload", row_type(docs))
    kept = docs.select(whole_row(docs).alias("payload")).mapInArrow(lambda it: _accept(it, text_col, given.value), out)
    return kept.select(*[F.col("payload").getField(c).alias(c) for c in docs.columns])
