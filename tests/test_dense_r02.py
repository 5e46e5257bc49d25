"""Searches stopped by time: a query used to order all vectors by exact keys where few can be among its best."""

import numpy as np
import pyarrow as pa
import pytest

from threadloom.operators import dense as D


def _block(vectors):
    return D._Block(pa.table({"id": pa.array(np.arange(len(vectors))), "own": pa.array(vectors, pa.list_(pa.float64()))}), len(vectors[0]), 6)


@pytest.mark.parametrize("kind", ["spread", "copies", "close", "strange", "wide"])
def test_the_best_are_always_likely(kind):
    dice, n = np.random.default_rng(7), 5_000
    vectors = dice.normal(size=(n, 16))
    if kind == "copies":
        vectors = vectors[np.arange(n) % 40]  # ties at every score, so ids decide
    if kind == "close":
        vectors = vectors[0] + 1e-6 * vectors  # scores apart by less than single precision tells
    vectors = list(vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True)))
    if kind == "strange":
        vectors[5] = np.full(16, np.nan)
    if kind == "wide":
        vectors[5] = vectors[5][:7]
    block = _block(vectors)
    asked, sizes = D._matrix(pa.chunked_array([pa.array([vectors[k] for k in (0, 5, 17, 4_999)], pa.list_(pa.float64()))]))
    for most in (1, 30, 77, 78, 79, 6_000):
        for vector, size, likely in zip(asked, sizes, block.likely(asked, sizes, most), strict=True):
            assert sorted(D._least(block.keys(vector, size), most)) == sorted(D._least(block.keys(vector, size, likely), most))


def test_few_are_ordered_exactly():
    vectors = np.random.default_rng(7).normal(size=(20_000, 16))
    vectors /= np.sqrt((vectors * vectors).sum(1, keepdims=True))
    found = [len(x) for x in _block(list(vectors)).likely(vectors[:200], np.full(200, 16), 30)]
    assert len(found) == 200 and min(found) >= 30 and max(found) < 100
