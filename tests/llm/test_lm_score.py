import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from threadloom.llm import lm_score
from threadloom.llm.lm_score import BUCKETS, GATES, LEVELS, ORDERS, WAY_BITS, WAYS, Bits, Decisions, K, Learner, Mixing, Spelling, count_slots, fit, fit_spelling, packed, score_documents, unpacked

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return TOKEN.findall("".join(c.lower() if c.isascii() else c for c in text or "")) + [""]


def held(doc):
    return doc is not None and crc32(str(doc).encode()) % 7 == 2


def brute_base(rows):
    counts = Counter(t for doc, text in rows if not held(doc) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for doc, text in rows:
        own = tokens(text)
        out.setdefault(doc, []).append((held(doc), len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)))
    return out


def check(df, rows):
    got, want = score_documents(df).collect(), brute_base(rows)
    assert len(got) == len(rows)
    for r in got:
        own = min(want[r.doc_id], key=lambda w: abs(w[4] - r.base_score))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == own[:4]
        assert math.isclose(r.base_score, own[4], rel_tol=1e-9, abs_tol=1e-9)
        assert r.score <= 0 and r.bits_per_byte >= 0
    return got


def test_base_equals_brute_force(odd, odd_rows, small, empty):
    check(odd, [r[:2] for r in odd_rows])
    assert score_documents(empty).count() == 0


def test_held_out_texts_are_scored_better_than_by_the_base(small):
    got = check(small, [(r.doc_id, r.text) for r in small.collect()])
    own = [r for r in got if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert sum(r.bits_per_byte for r in own) / len(own) < 3.2  # a byte of these texts takes 8 bits as it stands


def squash(x):
    return 1 / (1 + math.exp(-min(max(x, -12), 12)))


def chance(mixed, refined):
    return min(max((squash(mixed) + refined[min(max(round((mixed + 8) * 2), 0), BUCKETS - 1)]) / 2, 1e-6), 1 - 1e-6)


def slow_score(c, spelt, trains, n_train, n_docs, model):
    """One text by a plain loop; c: counts of the 1, 2 and 3 tokens that end at each place."""
    total, nth, past, run, weights, changes, stop_of = 0.0, 0, (3, 3, 3), 0, {}, {}, lambda n: (n // lm_score.FIRST_STOP).bit_length()
    for i in range(len(c[0])):
        k = [max(x[i] - trains, 0) for x in c]
        n = [max(n_train - trains, 1), max((c[0][i - 1] if i else n_docs) - trains, 0), max((c[1][i - 1] if i else n_docs) - trains, 0)]
        k[1], k[2] = min(k[1], n[1]), min(k[2], n[2])
        level = 0 if k[2] else 1 if k[1] else 2 if k[0] else 3
        total += spelt[i] if level == 3 else math.log10(k[2 - level] / n[2 - level])
        q = [x.bit_length() for x in n]
        for kind in range(min(level, 2) + 1):
            if kind < 2 and not n[2 - kind]:
                continue
            own = q[2] if kind == 0 else q[1]
            gate, bit = (kind * 4 + past[0]) * 4 + min(own, 3), int(level == kind)
            ways = (own, (past[0] * 4 + past[1]) * 4 + past[2], (own * 4 + past[0]) * 4 + past[1], n[1], (q[2] * 64 + q[1]) * 4 + past[0], run.bit_length() * 64 + own)
            slots = [((x * 3 + kind) * 0x9E3779B1 + (w + 1) * 0x85EBCA77) % (1 << 32) >> (32 - WAY_BITS) for w, x in enumerate(ways)]
            odds = [model.odds[w, s] for w, s in enumerate(slots)]
            if nth and stop_of(nth) != stop_of(nth - 1):
                for g, changed in changes.items():
                    weights[g] = [w + lm_score.ADAPT * sum(e * o[j] for e, o in changed) / (len(changed) + lm_score.FIRST_STOP) for j, w in enumerate(weights[g])]
                changes = {}
            own_weights = weights.setdefault(gate, list(model.weights[gate]))
            mixed = sum(w * o for w, o in zip(own_weights, odds, strict=True))
            p = chance(mixed, model.refined[gate])
            total += math.log10(p if bit else 1 - p)
            changes.setdefault(gate, []).append((bit - squash(mixed), odds))
            nth += 1
        run = run + 1 if level == 0 else 0
        past = (level, *past[:2])
    return total


def test_scores_equal_a_plain_loop(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(lm_score, "SPARE_BITS", 30)  # no n-gram takes another's count here
    rng = random.Random(8)
    vocabulary = "the of and to in is on that by this with you it not or be are from at as".split()
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "ing", "x" + str(i)]) for _ in range(rng.randrange(300))) for i in range(40)]
    rows = [r[:2] for r in odd_rows] + [(1000 + i, t) for i, t in enumerate(texts)] + [(2000 + i, t) for i, t in enumerate(texts[:9])]
    counted, model = fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    grams = [Counter(), Counter(), Counter()]
    for doc, text in rows:
        if not held(doc):
            own = ["^", "^", *tokens(text)]
            for n in range(3):
                grams[n].update(tuple(own[i - n : i + 1]) for i in range(2, len(own)))
    n_docs = sum(not held(doc) for doc, _ in rows)
    assert model.n_docs == n_docs and model.n_train == sum(grams[0].values()) and model.n_types == len(grams[0])
    texts_of, seen = {}, 0
    for doc, text in rows:
        texts_of.setdefault(doc, []).append(text)
    for row in counted.collect():
        c1, c2, c3, lengths = (unpacked(row[x]) for x in ("c1", "c2", "c3", "lengths"))
        spelt, ends = np.zeros(len(c1)), np.cumsum(lengths)
        spelt[c1 <= 1] = unpacked(row["spelt"]).astype(np.uint32).view(np.float32)
        got = np.concatenate([model.mixing.log10(own) for _, _, _, own in lm_score._groups(row, model.n_train, model.n_docs, 5000)])
        for k, (doc, a, z) in enumerate(zip(row["doc_ids"], ends - lengths, ends, strict=True)):
            counts = [x[a:z].tolist() for x in (c1, c2, c3)]
            want = []
            for text in texts_of[doc]:
                words = ["^", "^", *tokens(text)]
                want.append([[grams[n][tuple(words[i - n : i + 1])] for i in range(2, len(words))] for n in range(3)])
            assert counts in want
            assert math.isclose(got[k], slow_score(counts, spelt[a:z].tolist(), int(not held(doc)), model.n_train, n_docs, model.mixing), rel_tol=1e-9), doc
            seen += 1
    assert seen == len(rows)


def test_scores_do_not_depend_on_how_rows_are_dealt_out(spark, odd):
    take = lambda n: sorted((r.doc_id or 0, r.n_tokens, r.base_score) for r in score_documents(odd.repartition(n)).collect())
    assert take(1) == take(4)
    counted, model = fit(odd)
    for row in counted.collect():  # texts alone and together
        whole, alone = (np.concatenate([model.mixing.log10(own) for _, _, _, own in lm_score._groups(row, model.n_train, model.n_docs, n)]) for n in (1 << 18, 1))
        assert np.allclose(whole, alone, rtol=1e-9)


def vocabulary_of(spark, counts):
    """Token counts as the buckets give them."""
    rows = [(len(part), lm_score.packed_words([w for w, _ in part]), packed(np.array([c for _, c in part]))) for part in (counts[::2], counts[1::2]) if part]
    return spark.createDataFrame(rows, "n long, words binary, counts binary").repartition(2)


def test_spelling_follows_from_its_tables(spark, small):
    """A plain loop over one token's bits gives the same chance, with and without the token's own occurrence."""
    counts = sorted(Counter(t.encode() for r in small.collect() for t in tokens(r.text)).items())
    model = fit_spelling(vocabulary_of(spark, counts))
    whole = np.zeros((K, 2 << lm_score.SLOT_BITS), np.int64)
    count_slots([w for w, _ in counts], whole)
    for word, known in [(b"", False), (b"the", True), (b"unseenwordhere", False), ("é".encode() * 9, False), (b"a" * 40, False), (counts[9][0], True)]:
        total = 0.0
        for place, partial, bit, slots in Bits([word]).steps():
            for i in range(len(word) + 1):
                odds, seen, level = [], 0, 0
                for k in range(K):
                    z, o = whole[k][2 * slots[k][i]], whole[k][2 * slots[k][i] + 1]
                    z, o = (max(z - (known and not bit[i]), 0), max(o - (known and bit[i]), 0))
                    odds.append(round(1000 * min(max(math.log((o + lm_score.DELTA) / (z + lm_score.DELTA)), -8), 8)) / 1000)
                    if z + o > 0:
                        seen, level = k + 1, sum(z + o >= x for x in LEVELS)
                gate = (seen * (len(LEVELS) + 1) + level) * 8 + place
                p = chance(sum(w * x for w, x in zip(model.weights[gate], odds, strict=True)), model.refined[partial[i]])
                total += math.log10(p if bit[i] else 1 - p)
        assert math.isclose(model.log10([word], np.array([known]))[0], total, rel_tol=1e-3), word  # log-odds are held in thousandths
    again = fit_spelling(vocabulary_of(spark, counts))
    assert np.allclose(model.weights, again.weights) and model.counts == again.counts


def test_untrained_models_are_even():
    flat = Spelling(np.zeros((K, 2 << lm_score.SLOT_BITS)), np.zeros((lm_score.SPELL_GATES, K)), np.full((256, BUCKETS), 0.5))
    assert np.allclose(flat.log10([b"ab", b""], np.zeros(2, bool)), [-24 * math.log10(2), -8 * math.log10(2)])
    own = Decisions(*np.zeros((3, 3), np.int64), np.full(3, -1.0), np.array([2, 1]), np.zeros(2, bool), 0, 0)
    even = Mixing(np.zeros((WAYS, 1 << WAY_BITS)), np.zeros((GATES, WAYS)), np.full((GATES, BUCKETS), 0.5))
    assert np.allclose(even.log10(own), [-2 - 2 * math.log10(2), -1 - math.log10(2)])  # only whether the token is known is asked


def test_texts_that_occur_twice_are_told_apart(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:40])]
    got = {r.doc_id: r.bits_per_byte for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [got[i] for i in range(40) if not (held(i) or held(1000 + i))]
    once = [got[i] for i in range(40, 300)]
    assert max(twice) < min(once) / 2


def test_a_pass_goes_on_through_all_texts():
    rng = np.random.default_rng(1)
    make = lambda: Decisions(*rng.integers(0, 3, (3, 4000)), np.zeros(4000), np.full(40, 100), np.ones(40, bool), 9000, 40)
    own = Learner(np.full((GATES, WAYS), 0.3))
    first, second = make(), make()
    own.learn(first)
    before = own.weights.copy()
    own.learn(second)
    assert not np.array_equal(before, own.weights) and own.seen.sum() == len(first.bit) + len(second.bit) == own.counts[0].sum()


def test_numbers_come_back():
    for values in ([], [0], [255, 3], [256, 0, 65535], [1 << 40, 7], [(1 << 63) + 5]):
        assert unpacked(packed(np.array(values, np.uint64))).tolist() == values
    assert lm_score.unpacked_words(lm_score.packed_words([b"", b"a"]), 2) == [b"", b"a"] and lm_score.unpacked_words(lm_score.packed_words([b""]), 1) == [b""]
    same = Bits([b"abcab", b"ab"]).contexts[ORDERS.index(5)]
    assert same[0] == same[6] and same[1] == same[7] and same[2] == same[8]  # equal prefixes


def test_places_in_order():
    rng = np.random.default_rng(4)
    for keys in (np.zeros(0, np.uint64), rng.integers(0, 50, 400).astype(np.uint64), rng.integers(0, 1 << 63, 400).astype(np.uint64) << np.uint64(1)):
        order, of = lm_score.ranked(keys)
        names, at = np.unique(keys, return_inverse=True)
        assert (keys[order] == np.sort(keys)).all() and (at[order] == of).all()
