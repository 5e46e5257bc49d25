from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from threadloom.llm.sharding import block_sizes, hypergeometric, matrix_row, uniform_shards, write_shards


def check(df, rows, **kw):
    got = uniform_shards(df, **kw).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(kw.get("shards", 24))]
    assert max(sizes) - min(sizes) <= 1
    return got


def test_exact_sizes_and_gapless_slots(odd, odd_rows, small):
    check(odd, [r[:2] for r in odd_rows])
    check(odd, [r[:2] for r in odd_rows], shards=3, block_rows=4)
    own = [(r.doc_id, r.text) for r in small.collect()]
    assert check(small.repartition(7, "doc_id"), own) == check(small.repartition(7, "doc_id"), own)


def test_empty(empty):
    assert uniform_shards(empty).count() == 0
    with pytest.raises(ValueError):
        uniform_shards(empty, shards=0)


def test_matrix_has_its_sums():
    sizes = np.array([5, 0, 17, 3, 40])
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    columns, _ = block_sizes(65, 4, 10)
    rows = np.array([matrix_row(prefix, columns, p, 1) for p in range(5)])
    assert (rows.sum(axis=1) == sizes).all() and (rows.sum(axis=0) == columns).all()


def test_placement_is_uniform():
    sizes, hits = np.array([10, 30]), 0
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    columns = np.array([20, 20])
    for seed in range(4000):
        hits += matrix_row(prefix, columns, 0, seed)[0]
    assert abs(hits / 4000 - 5) < 0.1  # mean of the hypergeometric law; its spread over 4000 draws is 0.022


def test_large_populations():
    rng = np.random.default_rng(5)
    draws = np.array([hypergeometric(rng, 3 * 10**11, 7 * 10**11, 10_000) for _ in range(2000)])
    assert abs(draws.mean() - 3000) < 5 and abs(draws.std() - 45.8) < 4


def test_write(spark, small, tmp_path):
    back = write_shards(small, f"file://{tmp_path}/out", shards=3)
    clashing = small.limit(9).selectExpr("doc_id", "text", "lang AS shard", "source AS slot", "n_chars AS __id", "lang AS __slot")
    again = write_shards(clashing, f"file://{tmp_path}/again", shards=2)
    assert set(again.columns) == {*clashing.columns, "shard_", "slot_"} and Counter(map(tuple, again.select(*clashing.columns).collect())) == Counter(map(tuple, clashing.collect()))
    assert back.count() == small.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}
