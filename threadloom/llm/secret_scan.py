"""Secret scans by a randomness test battery.

Beside three fixed kinds of pattern, every run of encoding characters is a candidate if an encoding can be inferred
for it. A battery asks whether its symbols look uniform in that alphabet: chi-squared uniformity, a runs test about the
alphabet's middle and the lag-one serial correlation, joined by Fisher's method. Against the null hypothesis that the
run is ordinary text, 1 / (likelihood under uniform symbols / likelihood under a text model) is a valid p-value;
candidates that pass the battery are reported where a Benjamini-Hochberg bound holds within their class of lengths, so
the many short runs of a corpus can't hide, or stand in for, the few long ones. The bound needs only a histogram of
p-values by length class, which has a fixed size. Runs of letters alone are tested in their own alphabets, against words
of four languages; digits alone are tested as hex, where nothing tells them from an ordinary number. Runs of fewer than
LEAST_RUN characters are no candidates: no test could tell so few symbols from text.

Defined cases: null text is empty; empty text has no spans; very long texts are scanned whole; offsets count code points, ends
are exclusive; spans that begin together stand in the order of KINDS; repeated rows are each scanned and each counted as tests; an
empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialise, quoted, to_arrow_schema

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more: the same as dropping shorter runs
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_RUN = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the narrowest alphabet on, in the order in which values are numbered.
ENCODINGS = (
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
#: The same with alphabets of letters alone.
ALL_ENCODINGS = (*ENCODINGS[:2], ("lower", LOWER), ("upper", UPPER), *ENCODINGS[2:5], ("letters", UPPER + LOWER), *ENCODINGS[5:])
#: Share of English letters in percent, a to z.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: The same in German, French and Spanish.
MORE_LETTERS = (
    (6.51, 1.89, 3.06, 5.08, 17.4, 1.66, 3.01, 4.76, 7.55, 0.27, 1.21, 3.44, 2.53, 9.78, 2.51, 0.79, 0.02, 7.0, 7.27, 6.15, 4.35, 0.67, 1.89, 0.03, 0.04, 1.13),
    (7.64, 0.9, 3.26, 3.67, 14.7, 1.07, 0.87, 0.74, 7.53, 0.61, 0.07, 5.46, 2.97, 7.1, 5.8, 2.52, 1.36, 6.69, 7.95, 7.24, 6.31, 1.84, 0.05, 0.43, 0.13, 0.33),
    (11.5, 2.22, 4.02, 5.01, 12.2, 0.69, 1.77, 0.7, 6.25, 0.49, 0.01, 4.97, 3.16, 6.71, 8.68, 2.51, 0.88, 6.87, 7.98, 4.63, 2.93, 1.14, 0.02, 0.22, 1.01, 0.47),
)
STAY = 0.85  # the text model stays in a class of characters with this chance
_TEXT = {c: math.log(p / sum(LETTERS)) for c, p in zip(LOWER, LETTERS, strict=True)} | {c.upper(): math.log(p / sum(LETTERS)) for c, p in zip(LOWER, LETTERS, strict=True)} | {c: -math.log(10) for c in DIGITS} | {c: -math.log(4) for c in "+/-_"}
_WORDS = [_TEXT, *({c: math.log(p / sum(own)) for c, p in zip(LOWER + UPPER, own * 2, strict=True)} for own in MORE_LETTERS)]
_CLASS = {c: k for k, own in enumerate((LOWER, UPPER, DIGITS, "+/-_")) for c in own}
BATTERY = 1e-3  # a run is called random unless the battery's joint p-value is below this
FALSE_DISCOVERIES = 0.01
LENGTH_CLASSES = (24, 32, 48, 64)  # upper bounds; longer runs are a class of their own
BINS = 400  # of -log10 p, a tenth each


def inferred(run: str) -> tuple[str, str] | None:
    """The narrowest encoding of any run, be it of letters or digits alone: the tests tell words and numbers apart."""
    own = set(run)
    return next(((name, alphabet) for name, alphabet in ALL_ENCODINGS if own <= set(alphabet)), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(run: str, alphabet: str) -> dict[str, float]:
    """p-values of uniformity, runs and serial correlation, and of all three together."""
    n, k = len(run), len(alphabet)
    value = np.array([alphabet.index(c) for c in run])
    cells = max(2, min(k, n // 4))  # at least four symbols are expected in a cell
    edges = (np.arange(k) * cells) // k
    expected = n * np.bincount(edges, minlength=cells) / k
    chi = float((((np.bincount(edges[value], minlength=cells) - expected) ** 2) / expected).sum())
    df = cells - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson and Hilferty
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    high = value >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        runs_p = _normal_tail((runs - mean) / spread)
    else:
        runs_p = 2.0 ** (1 - n)
    centred = value - (k - 1) / 2
    serial = _normal_tail(float((centred[1:] * centred[:-1]).sum()) / (((k * k - 1) / 12) * math.sqrt(n - 1)))
    x = -sum(math.log(max(p, 1e-300)) for p in (uniform, runs_p, serial))
    return {"uniform": uniform, "runs": runs_p, "serial": serial, "joint": math.exp(-x) * (1 + x + x * x / 2)}


def text_evidence(run: str, alphabet: str) -> float:
    """-log10 of the p-value against ordinary text (0: nothing speaks against text)."""
    text = max(sum(own[c] for c in run) for own in (_WORDS if run.isalpha() else _WORDS[:1])) - math.log(4)
    for a, b in zip(run, run[1:], strict=False):
        text += math.log(STAY if _CLASS[a] == _CLASS[b] else (1 - STAY) / 3)
    return max(0.0, (-len(run) * math.log(len(alphabet)) - text) / math.log(10))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three fixed kinds, leftmost and non-overlapping within each kind; too short ones are dropped."""
    out = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, bin of evidence) of every tested run that no base span touches; bin -1: the battery fails it."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m.group().rstrip("=")
        if (found := inferred(run)) and not any(a < m.end() and m.start() < z for _, a, z in base):
            size = next((k for k, most in enumerate(LENGTH_CLASSES) if len(run) <= most), len(LENGTH_CLASSES))
            evidence = text_evidence(run, found[1])
            random = evidence > 0 and battery(run, found[1])["joint"] >= BATTERY
            out.append((*m.span(), size, min(BINS - 1, int(10 * evidence)) if random else -1))
    return out


SPAN = T.StructType().add("kind", "string").add("start", "long").add("end", "long")
TEST = T.StructType().add("start", "long").add("end", "long").add("size", "integer").add("bin", "integer")
SCAN = T.StructType().add("doc_id", "long").add("base", T.ArrayType(SPAN)).add("tests", T.ArrayType(TEST))


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate(KINDS)}
    for batch in chunks(batches):
        bases, tests = [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text) if text else []
            bases.append([{"kind": k, "start": a, "end": z} for k, a, z in sorted(base, key=lambda s: (s[1], order[s[0]]))])
            tests.append([{"start": a, "end": z, "size": c, "bin": b} for a, z, c, b in candidates(text, base)] if text else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, schema.field("base").type), pa.array(tests, schema.field("tests").type)], schema=schema)


def least_bins(counts: list[tuple[int, int, int]], level: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Benjamini-Hochberg on binned p-values: by length class the least bin that is reported. counts: (class, bin, tests).

    A test counts with the p-value at its bin's weak edge, so binning never adds discoveries.
    """
    out = {}
    for size in sorted({c[0] for c in counts}):
        own = {b: n for s, b, n in counts if s == size}
        m, kept = sum(own.values()), 0
        for b in sorted((b for b in own if b > 0), reverse=True):
            kept += own[b]
            if 10 ** (-b / 10) <= level * kept / m:
                out[size] = b
    return out


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", level: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per document: doc_id, base spans, and all spans (base ones and random runs), in order."""
    schema = to_arrow_schema(SCAN)
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    found = materialise(slim.mapInArrow(lambda it: _scan(it, schema), SCAN), "secrets")
    histogram = found.select(F.explode("tests").alias("t")).groupBy("t.size", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    least = least_bins([(r["size"], r["bin"], r["n"]) for r in histogram.collect()], level)  # at most 5 x 401 rows
    bound = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else None
    more = F.transform(F.filter("tests", lambda t: t["bin"] >= F.coalesce(F.try_element_at(bound, t["size"]), F.lit(BINS))), lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end"))) if least else F.lit(None).cast(T.ArrayType(SPAN))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(F.concat("base", F.coalesce(more, F.array().cast(T.ArrayType(SPAN)))), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", "base", F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
