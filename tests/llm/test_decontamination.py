import hashlib
import re
from collections import Counter

from threadloom.llm.decontamination import build_index, contamination, drop_contaminated, search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window=10):
    out = Counter()
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n, own in grams.items():
            for i in range(len(w) - n + 1):
                if found := own.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        out[(doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    return out


def of(df):
    return Counter(map(tuple, df.drop("key").collect()))


def test_equals_brute_force(spark, small, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in small.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = of(contamination(small, items))
    assert got == want and any(k[5] for k in got)


def test_odd_rows(spark, odd, odd_rows):
    long = next(r[1] for r in odd_rows if r[0] == 6)
    w = words(long)
    items = [(1, "ONE"), (2, "one, two"), (3, None), (4, "..."), (5, " ".join(w[100:125])), (6, " ".join(w[-10:])), (6, " ".join(w[-10:])), (None, "without id"), (7, " ".join(w[5:14] + ["no"]))]
    items += [(100 + i, " ".join(words(odd_rows[12 + 5 * i][1])[i : i + 14])) for i in range(10)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = brute([r[:2] for r in odd_rows], items)
    assert of(contamination(odd, frame)) == want
    index = build_index(odd)
    one, many = search(index, frame), search(index, frame, item_bytes=300)
    flat = lambda df: Counter((r.segment, r.place, r.n_words, tuple(sorted(map(tuple, r.spans)))) for r in df.collect())
    assert flat(one) == flat(many)


def test_dropping(spark, odd, odd_rows, empty):
    frame = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    kept = drop_contaminated(odd, frame)
    assert kept.columns == odd.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter(r for r in odd_rows if r[1] != "one two")
    assert contamination(empty, frame).count() == 0
    assert drop_contaminated(odd, spark.createDataFrame([], "item_id long, text string")).count() == len(odd_rows)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c d"), (2, "a b c d"), (3, "a x y b c d"), (4, "d c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c d")], "item_id long, text string")
    index = build_index(docs)
    found = lambda slop: {r.doc_id: [(s.start, s.end) for s in r.spans] for r in search(index, items, slop=slop).collect() if r.spans}
    assert found(0) == {2: [(0, 4)]}
    assert found(1) == {1: [(0, 5)], 2: [(0, 4)]}
    assert found(2) == {1: [(0, 5)], 2: [(0, 4)], 3: [(0, 6)]}
