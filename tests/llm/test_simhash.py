import random
from collections import Counter

import numpy as np
import xxhash

from threadloom.operators.components import components
from threadloom.llm.simhash import drop_near_duplicates, links, near_duplicates


def fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=3):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    own = classes(prints)
    least = {c: min((rows[i][0] for i in range(len(rows)) if own[i] == c and rows[i][0] is not None), default=None) for c in set(own)}
    return Counter((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, own, strict=True))


def test_equals_brute_force(odd, odd_rows, small, empty):
    assert Counter(map(tuple, near_duplicates(odd).collect())) == brute([r[:2] for r in odd_rows])
    assert Counter(map(tuple, near_duplicates(small).collect())) == brute([(r.doc_id, r.text) for r in small.collect()])
    assert near_duplicates(empty).count() == 0


def test_one_row_of_each_component_stays(odd, odd_rows, empty):
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    want = {c for _, _, c in brute([r[:2] for r in odd_rows])}
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want
    assert drop_near_duplicates(empty).count() == 0


def test_hot_groups_lose_no_component(spark):
    rng = random.Random(4)
    prints = set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(120):  # many share a segment
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))))
        for _ in range(150):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(32), rng.randrange(9))))
        for _ in range(150):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(16), rng.randrange(9))))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "print long")
    own = classes(prints)
    for hot in (1024, 20, 5):
        least = {r.node: r.least for r in components(links(frame, hot=hot)).collect()}
        got = {}
        for x, c in zip(signed, own, strict=True):
            got.setdefault(c, set()).add(least.get(x, x))
        assert all(len(s) == 1 for s in got.values()) and len(set(map(min, got.values()))) == len(got), hot


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + rng.randrange(400), 5000 + rng.randrange(400)) for _ in range(250)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.least for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
