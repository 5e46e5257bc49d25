import hashlib
from collections import Counter, defaultdict

from threadloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            kept, first = (True, False) if i == keep and first else (False, first)
            out[(i, keep, len(ids), kept, digest)] += 1
    return out


def test_equals_brute_force(odd, odd_rows, small):
    assert Counter(map(tuple, exact_duplicates(odd).collect())) == brute([r[:2] for r in odd_rows])
    own = [(r.doc_id, r.text) for r in small.collect()]
    assert Counter(map(tuple, exact_duplicates(small).collect())) == brute(own)


def test_spill_files_change_nothing(small):
    assert Counter(map(tuple, exact_duplicates(small, bucket_bytes=2000).collect())) == Counter(map(tuple, exact_duplicates(small).collect()))


def test_rows_that_stay_keep_their_columns(odd, odd_rows):
    for bytes_held in (1 << 20, 500):
        kept = drop_exact_duplicates(odd, bucket_bytes=bytes_held)
        assert kept.columns == odd.columns
        got = [tuple(r) for r in kept.collect()]
        best = {}
        for r in odd_rows:
            key = r[1] or ""
            if key not in best or (r[0] or -1) > (best[key][0] or -1):
                best[key] = r
        assert Counter(got) == Counter(best.values())


def test_empty(empty):
    assert exact_duplicates(empty).count() == 0
    assert drop_exact_duplicates(empty).count() == 0


def test_open_table_compares_contents():
    from threadloom.llm.exact_dedup import OpenTable

    table = OpenTable()
    for i in range(5000):
        assert table.entry(7 if i < 100 else i, b"%d" % i) == (i, True)
    assert table.entry(7, b"42") == (42, False)
    assert table.entry(4999, b"4999") == (4999, False)
