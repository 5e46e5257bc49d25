from collections import Counter

from test_decontamination import brute as brute_hits
from test_simhash import brute as brute_classes
from tokenizers import Tokenizer

import corpus_pipeline
from threadloom.llm.encoder import default_path
from threadloom.llm.language_id import fit, identify


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rejected = {r.doc_id for r in identify(docs, fit(docs)).collect() if r.rejected}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in rejected}
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    rows = {i: rows[i] for i in last.values()}
    rows = {i: rows[i] for _, _, i in brute_classes(list(rows.items()))}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {k[0] for k in brute_hits(list(rows.items()), items) if k[5]}
    rows = {i: t for i, t in rows.items() if i not in bad}
    whole = Tokenizer.from_file(default_path())
    want = Counter()
    for i, text in rows.items():
        n = len(whole.encode(text, add_special_tokens=False).ids) + 1
        for k, at in enumerate(range(0, n, 2048)):
            want[(i, k, at, min(2048, n - at))] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(tuple(r)[:4] for r in got) == want
    assert bad and len(rows) < docs.count()


def test_stages_take_odd_rows(spark, odd, empty, sf):
    for frame in (odd, empty):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == frame.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= (frame is odd)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
