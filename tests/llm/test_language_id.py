import random
from collections import Counter, defaultdict
from math import log2
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import language_id
from threadloom.llm.language_id import BEGIN, END, Models, drop_rejected, fit, identify, letters, raw_words


def slow_costs(counts, lang, word, order):
    """Interpolated Kneser-Ney straight from its definition."""
    symbols = {c for own in counts.values() for w in own for c in w}
    levels = []
    raw = [Counter() for _ in range(order + 1)]
    for w, n in counts[lang].items():
        s = BEGIN + w + END
        for i in range(1, len(s)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    raw[k][s[i - k + 1 : i + 1]] += n
    for k in range(1, order + 1):
        if k < order:
            before = defaultdict(set)
            for g in raw[k + 1]:
                before[g[1:]].add(g[0])
            own = {g: n if g[0] == BEGIN or g not in before else len(before[g]) for g, n in raw[k].items()}
        else:
            own = dict(raw[k])
        ones, twos = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        levels.append((own, ones / (ones + 2 * twos) if ones and twos else 0.5))
    s, bits = BEGIN + word + END, 0.0
    for i in range(1, len(s)):
        p = 1 / (len(symbols) + 2)
        for k in range(1, order + 1):
            if i - k + 1 < 0:
                break
            own, d = levels[k - 1]
            h, g = s[i - k + 1 : i], s[i - k + 1 : i + 1]
            heads = {x: n for x, n in own.items() if x[:-1] == h}
            if heads:
                total = sum(heads.values())
                p = (heads[g] - d if g in heads else 0) / total + d * len(heads) / total * p
        bits -= log2(p)
    return bits


def test_costs_equal_the_definition():
    rng = random.Random(6)
    counts = {lang: Counter({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))): rng.randrange(1, 9) for _ in range(60)}) for lang, letters in (("aa", "abcdeé"), ("bb", "defgß"))}
    for order in (1, 2, 3, 5):
        models = Models(counts, order)
        words = [*list(counts["aa"])[:10], *list(counts["bb"])[:10], "zzz", "", "abé"]
        bits, symbols = models.costs(words)
        for i, w in enumerate(words):
            for k, lang in enumerate(("aa", "bb")):
                want = slow_costs(counts, lang, w, order) if w else 0.0
                assert abs(bits[i, k] - want) < 1e-3, (order, w, lang)
            assert symbols[i] == (len(w) + 1 if w else 0)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in identify(docs, fit(docs)).collect()}
    labels = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(labels)
    held = [i for i in labels if crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in labels)
    assert sum(got[i].lang_pred == labels[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) == 0


def test_odd_rows(odd, odd_rows, empty, spark):
    models = fit(odd)
    assert models.languages == ["de", "en", "fr"]
    got = identify(odd, models).collect()
    want = Counter((r[0], r[0] is not None and crc32(str(r[0]).encode()) % 4 == 2) for r in odd_rows)
    assert Counter((r.doc_id, r.held_out) for r in got) == want
    for r in got:
        text = next(x[1] for x in odd_rows if x[0] == r.doc_id)
        if r.doc_id is not None and not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in models.languages and 0 <= r.score <= 1
    kept = drop_rejected(odd, models)
    assert kept.columns == odd.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter(r for r in odd_rows if any(c.isalpha() for c in r[1] or ""))
    assert identify(empty, fit(empty)).count() == 0
    assert {r.lang_pred for r in identify(odd, fit(empty)).collect()} == {"und"}


def noise(rng, words):
    return " ".join("".join(rng.choice("qxzjkwvyqx") for _ in range(8)) for _ in range(words))


def test_gibberish_is_rejected(spark, sf):
    """Long and short noise, whether its nearest language has many labelled rows or few."""
    rng = random.Random(7)
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    frame = spark.createDataFrame([(n, noise(rng, n)) for n in (400, 60, 25)], "doc_id long, text string")
    got = identify(frame, fit(docs)).collect()
    assert all(r.rejected and r.score < 0.05 for r in got)
    few = docs.where("lang = 'en' OR doc_id % 40 = 0")  # a few rows of the other languages
    assert all(r.rejected for r in identify(frame, fit(few)).collect())


@pytest.mark.parametrize("lang", ["de", "en", "es", "fr"])
def test_a_language_that_was_not_learnt_is_rejected(spark, sf, lang):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    models = fit(docs.withColumn("lang", F.when(F.col("lang") != lang, F.col("lang"))))
    assert lang not in models.languages
    got = identify(docs, models).join(docs.select("doc_id", "lang"), "doc_id").select("rejected", "score", (F.col("lang") == lang).alias("foreign")).collect()
    foreign, known = [r for r in got if r.foreign], [r for r in got if not r.foreign]
    assert sum(r.rejected for r in foreign) >= 0.9 * len(foreign) and sum(r.score for r in foreign) < 0.15 * len(foreign)
    assert sum(r.rejected for r in known) <= 0.005 * len(known)


def test_calibration_by_its_definition():
    """Few rows lean on all rows; the limit lies where the fitted tail leaves the share of false rejections."""
    rng = np.random.default_rng(3)
    models = Models({x: Counter({"ab": 2, "ba": 1, x * 3: 4}) for x in "cde"})
    own = np.array([0] * 900 + [1] * 90 + [2])
    symbols = rng.integers(50, 3000, len(own))
    mine = 2 + 0.1 * own + rng.normal(0, 0.1, len(own)) + rng.normal(0, 1, len(own)) / np.sqrt(symbols)
    cross = np.stack([np.where(own == k, mine, mine + 1.5) for k in range(3)], axis=1)
    models.calibrate(own, cross, symbols, np.ones(len(own)))
    assert abs(models.mean[0] - 2) < 0.03 and abs(models.mean[2] - (mine[-1] + 20 * mine.mean()) / 21) < 1e-9
    z = np.sort(models.distance(own, mine, symbols))
    top = z[-int(language_id.TAIL * len(z)) :]
    tail = ((top - top[0]).sum() + 1) / len(top)
    assert np.isclose(models.limit, max(top[0], 1) + tail * np.log(len(top) / len(z) / language_id.FALSE_REJECTIONS))
    assert models.limit < 25 and (models.distance(np.array([2]), np.array([5.0]), np.array([200])) > models.limit).all()


def test_many_labels(spark):
    """A dirty label column: the most frequent labels are learnt."""
    rows = [(i, f"some words of label {i % 400} here", "en" if i % 3 else f"x{i}") for i in range(900)]
    models = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=5)
    assert len(models.languages) == 5 and "en" in models.languages


def slow_prediction(models, counts, text):
    """Language and cross-entropies word by word from the definition."""
    words = [letters(w) for w in raw_words(text.encode())]
    bits = {lang: sum(slow_costs(counts, lang, w, models.order) for w in words if w) / max(1, sum(len(w) + 1 for w in words if w)) for lang in counts}
    return min(sorted(bits), key=bits.get), bits


def test_predictions_equal_the_definition():
    rng = random.Random(16)
    counts = {lang: Counter({"".join(rng.choice(own) for _ in range(rng.randrange(1, 6))): rng.randrange(1, 9) for _ in range(40)}) for lang, own in (("aa", "abcdeé"), ("bb", "cdefgß"), ("cc", "xyzab"))}
    models = Models(counts, 3)
    texts = [" ".join(rng.choice(list(counts[rng.choice(list(counts))])) for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["", "12 !"]
    models.mean, models.between, models.symbol, models.limit, models.tail, models.sharpness = np.array([2.0, 2.1, 2.2]), np.full(3, 0.1), np.full(3, 1.5), 1.0, 0.5, 3.0
    found = models.predict([t.encode() for t in texts])
    for text, lang, score, cross, rejected in zip(texts, *found, strict=True):
        n = sum(len(letters(w)) + 1 for w in raw_words(text.encode()) if letters(w))
        if not n:
            assert (lang, score, bool(rejected)) == ("und", 0.0, True)
            continue
        want, bits = slow_prediction(models, counts, text)
        k = models.languages.index(want)
        z = (bits[want] - models.mean[k]) / (0.1 + 1.5 / n) ** 0.5
        likely = 1 / sum(np.exp(-3.0 * (b - bits[want])) for b in bits.values())
        assert lang == want and abs(cross - bits[want]) < 1e-3
        assert abs(score - likely * np.exp(-max(z - 1.0, 0) / 0.5)) < 2e-2 and (bool(rejected) == (z > 1.0 or cross > models.most) or abs(z - 1) < 1e-2)


def test_letters():
    assert raw_words("Ab1c — É٣\n".encode()) == [b"ab", b"c", "—".encode(), "é٣".encode()]
    assert [letters(w) for w in raw_words("— é٣ don’t".encode())] == ["", "é", "dont"]
