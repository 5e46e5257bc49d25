"""Searches stopped by time: texts are split by array operations where they used to become lists of all their words."""

import random

import numpy as np
import pyarrow as pa

from threadloom.functions import splitting as P
from threadloom.functions import text as X
from threadloom.operators import search as S


def test_texts_split_as_the_engine_splits_them(spark):
    """Over all planes, with marks, empty texts and texts without words; every word is asked for."""
    dice, split = random.Random(4), P.folds(spark)
    near = "aZ09 é́ ßİıÅΑσς٣你好\U00010400\U0001d54f-_.\n\r\t\0"
    some = lambda: chr(dice.choice([dice.randrange(0x250), dice.randrange(0xD800), dice.randrange(0xE000, 0x40000), dice.randrange(0xE0000, 0x110000)]))
    texts = ["", " ", "a", "éa", "́", "a" * 70, *["".join(dice.choice(near) if dice.random() < 0.7 else some() for _ in range(dice.randrange(60))).replace("Σ", "") for _ in range(600)]]
    want = [r.w for r in spark.createDataFrame(pa.table({"n": list(range(len(texts))), "t": texts})).select("n", X.tokens("t").alias("w")).sort("n").collect()]
    for asked in (sorted({w for ws in want for w in ws}), ["a"], ["", "gone"], []):
        sizes, rows, places, codes = P.places_of(pa.array(["before", *texts], pa.string())[1:], asked, split.packed)
        assert sizes.tolist() == [len(ws) for ws in want]
        assert [(r, p, asked[c]) for r, p, c in zip(rows.tolist(), places.tolist(), codes.tolist(), strict=True)] == [(r, p, w) for r, ws in enumerate(want) for p, w in enumerate(ws) if w in set(asked)]
    assert split.odd == "Σ" and np.count_nonzero(P._table(split.packed) == P.ODD) == 1


def test_only_the_engine_splits_what_depends_on_neighbours(spark):
    """A final sigma, broken bytes, and both ways in one row of two fields."""
    docs = spark.sql("SELECT * FROM VALUES (1, 'ΟΔΟΣ the Σ', 'odos the'), (2, 'the', 'ΣΑΣ the'), (3, NULL, NULL) AS d(id, text, lang) UNION ALL SELECT 4, decode(X'41', 'UTF-8') || CAST(X'C328FF' AS STRING) || ' the', 'σας'")
    rows = lambda index: {(r.field, r.term, r.id, tuple(r.positions), r.length) for r in index.postings.collect()}
    whole = S.build_index(docs, "id", ["text", "lang"], True)
    asked = ["the", "οδος", "σας", "σασ", "σ"]
    assert (found := rows(S.build_index(docs, "id", ["text", "lang"], True, asked))) == {r for r in rows(whole) if r[1] in asked}
    assert {("text", "οδος", 1, (0,), 5), ("text", "the", 1, (1,), 5), ("lang", "σας", 2, (0,), 3), ("lang", "the", 2, (1,), 3), ("lang", "σας", 4, (0,), 3)} <= found
