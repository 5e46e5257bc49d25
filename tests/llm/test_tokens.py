import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from threadloom.llm.encoder import Encoder, default_path
from threadloom.llm.packing import best_fit, fractional, knapsack, pack, solve, solve_parts
from threadloom.llm.token_counts import at_limits, length_histogram, quantiles, token_counts


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(whole, small):
    rng, own = random.Random(1), Encoder(default_path())
    assert own.fast
    alphabet = "abcXYZ'sdmt re ve ll 0123 éßÉñ.,!|@#\n\t  <|endoftext|> ÿþÞ ÷ × ª ² \xa0 \x1c ı İ Σς é 中"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + [r.text for r in small.collect()]
    for text in texts:
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == whole(text)


def test_histogram(odd, odd_rows, empty, whole):
    counts = token_counts(odd).cache()
    lengths = [len(whole(r[1])) for r in odd_rows]
    assert Counter(map(tuple, counts.collect())) == Counter((r[0], n) for r, n in zip(odd_rows, lengths, strict=True))
    histogram = length_histogram(counts).cache()
    want = {n: (k, sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths)) for n, k in Counter(lengths).items()}
    assert {r[0]: tuple(r)[1:] for r in histogram.collect()} == want
    assert {tuple(r) for r in at_limits(histogram, [0, 2, 10**6]).collect()} == {(c, sum(x > c for x in lengths), sum(lengths), sum(min(x, c) for x in lengths)) for c in (0, 2, 10**6)}
    ordered = sorted(lengths)
    assert {r.share: r.n_tokens for r in quantiles(histogram, [0.0, 0.5, 1.0]).collect()} == {0.0: ordered[0], 0.5: ordered[-(-len(ordered) // 2) - 1], 1.0: ordered[-1]}
    assert length_histogram(token_counts(empty)).count() == 0


def check(df, rows, whole):
    got = pack(df).collect()
    want = Counter()
    for doc, text in rows:
        ids = [*whole(text), 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            want[(doc, k, at, len(cut), crc32(np.array(cut, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), -(-sum(r.length for r in got) // 2048)


def test_packing(odd, odd_rows, small, empty, whole):
    check(odd, [r[:2] for r in odd_rows], whole)
    used, bound = check(small, [(r.doc_id, r.text) for r in small.collect()], whole)
    assert used <= bound + 1
    assert pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    for n in rng.integers(1, 101, [3, 60, 4000][seed % 3]):
        counts[n] += rng.integers(1, 50 if seed < 3 else 2)
    for plan in (solve(counts, 100), best_fit(counts, 100)):
        used = np.zeros_like(counts)
        for content, times in plan:
            assert times > 0 and sum(s * n for s, n in content.items()) <= 100
            for s, n in content.items():
                used[s] += n * times
        assert (used == counts).all()
    assert sum(t for _, t in solve(counts, 100)) <= sum(t for _, t in best_fit(counts, 100))


@pytest.mark.parametrize("times", [0.2, 1, 30])
def test_the_program_makes_the_sequences(times):
    """On lengths as documents have them: a solution near the bound, nine of ten sequences from columns, none more than best fit."""
    rng = np.random.default_rng(5)
    counts = np.bincount(np.clip(rng.lognormal(6, 1.2, int(10_000 * times)).astype(int), 1, 2047), minlength=2049)
    bound = counts @ np.arange(2049) / 2048
    found = solve_parts(counts)
    program, rest = (sum(n for _, n in part) for part in (found.program, found.rest))
    assert found.objective <= 1.012 * bound
    assert program >= 0.9 * (program + rest) and program + rest <= sum(n for _, n in best_fit(counts, 2048))


def test_knapsack_equals_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        sizes, values, room = [rng.randrange(1, 9) for _ in range(7)], [rng.random() for _ in range(7)], rng.randrange(9, 20)
        best, _ = knapsack(np.array(sizes), np.array(values), room)
        sums = [(sum(s for k, s in enumerate(sizes) if m >> k & 1), sum(v for k, v in enumerate(values) if m >> k & 1)) for m in range(128)]
        assert np.allclose(best, [max(v for s, v in sums if s <= r) for r in range(room + 1)])


def test_columns_cover_no_length_twice():
    counts = np.zeros(101, np.int64)
    counts[[7, 20, 33, 40, 60, 100]] = [50, 9, 1, 30, 30, 2]
    found = fractional(counts, 100)
    covered = sum((x * np.bincount(own, n, 101) for x, own, n in zip(found.x, found.lengths, found.times, strict=True)), np.zeros(101))
    assert np.allclose(covered + found.uncovered, counts) and all((own * n).sum() == 100 for own, n in zip(found.lengths, found.times, strict=True))
