import random
import re
from collections import Counter

from threadloom.llm.license_scan import TEMPLATES, Automaton, compiled, license_digest, places, scan_licenses
from threadloom.llm.words import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def brute(doc, text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    places = [(i, k) for i in range(len(w)) for k, p in BASE.items() if w[i : i + len(p)] == p]
    return doc, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({k for _, k in places}))


def test_base_equals_brute_force(small, odd, odd_rows, empty):
    take = lambda df: Counter(tuple(r)[:6] for r in license_digest(scan_licenses(df)).collect())
    assert take(small) == Counter(brute(r.doc_id, r.text) for r in small.collect())
    assert take(odd) == Counter(brute(*r[:2]) for r in odd_rows)
    assert take(empty) == Counter()


def digest(spark, text):
    return license_digest(scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()


def test_wording_must_match_exactly(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    assert digest(spark, f"Copyright\n{isc} THE SOFTWARE").labels == "isc"
    assert digest(spark, isc.replace("all copies", "some copies")).labels == ""
    assert digest(spark, "Released under the MIT License. mit license").asDict() == {"doc_id": 1, "n_words": 7, "n_base": 2, "first_word": 3, "last_word": 5, "base_labels": "mit", "labels": "mit", "score": 1.0}
    got = digest(spark, "Licensed under the Apache License, Version 2.0, or the GNU general public LICENSE")
    assert (got.base_labels, got.labels, got.score) == ("apache,gpl", "apache,apache-2.0,gpl", 1.0)
    assert digest(spark, "Licensed under CC BY-NC 4.0.").labels == "cc-by-nc-4.0"
    assert digest(spark, "an mit license of sorts").score == 0.5


def test_optional_and_replaceable_regions():
    a = Automaton("x", "b", "a [[opt one]] b {{2}} c")
    ok = lambda s: a.match(words(s.encode()), 0)
    assert ok("a b c") == 3 and ok("a opt one b c") == 5 and ok("a b x c") == 4 and ok("a b x y c") == 5
    assert ok("a opt b c") is None and ok("a b x y z c") is None and ok("a c") is None


def test_templates_accept_their_own_wording():
    for label, key, wording in TEMPLATES:
        full = re.sub(r"\{\{\d+\}\}", "anyone", wording.replace("[[", " ").replace("]]", " "))
        least = re.sub(r"\{\{\d+\}\}", " ", re.sub(r"\[\[.*?\]\]", " ", wording, flags=re.S))
        for text in (full, least):
            w = words(text.encode())
            assert Automaton(label, key, wording).match(w, 0) == len(w), (label, text)
            assert key.encode() in w


PART = re.compile(r"\[\[(.*?)\]\]|\{\{(\d+)\}\}|([^\[{]+|[\[{])", re.S)


def slow_ends(parts, text, at):
    """All ends of runs from `at` that the markup accepts, by trying everything."""
    if not parts:
        return {at}
    (optional, free, plain), rest = parts[0], parts[1:]
    if free:
        return set().union(*(slow_ends(rest, text, at + k) for k in range(int(free) + 1) if at + k <= len(text)))
    if plain:
        own = words(plain.encode())
        return slow_ends(rest, text, at + len(own)) if text[at : at + len(own)] == own else set()
    return slow_ends(rest, text, at).union(*(slow_ends(rest, text, z) for z in slow_ends(PART.findall(optional), text, at)))


def slow_labels(text):
    found = []
    for label, _, wording in TEMPLATES:
        parts, at = PART.findall(wording), 0
        while at < len(text):
            ends = slow_ends(parts, text, at) - {at}
            found += [(label, at, max(ends))] if ends else []
            at = max(ends) if ends else at + 1
    return {x[0] for x in found if not any(a <= x[1] and x[2] <= z and z - a > x[2] - x[1] for _, a, z in found)}


def variants(rng, wording):
    """One reading of the markup."""
    out = []
    for optional, free, plain in PART.findall(wording):
        if optional and rng.random() < 0.6:
            out += variants(rng, optional)
        out += words(plain.encode()) if plain else [b"w%d" % i for i in range(rng.randrange(int(free) + 1))] if free else []
    return out


def test_automata_equal_a_plain_matcher():
    rng = random.Random(4)
    for _ in range(300):
        wording = " ".join(rng.choice(["a", "b", "c", "[[a]]", "[[b c]]", "{{2}}", "[[{{1}} c]]"]) for _ in range(rng.randrange(1, 6)))
        a, text = Automaton("x", "a", wording), [rng.choice([b"a", b"b", b"c"]) for _ in range(8)]
        for at in range(len(text)):
            want = slow_ends(PART.findall(wording), text, at) - {at}
            assert a.match(text, at) == (max(want) if want else None), (wording, text, at)


def test_labels_equal_a_plain_matcher(spark):
    rng = random.Random(5)
    texts = []
    for _, _, wording in TEMPLATES:
        own = variants(rng, wording)
        broken = [w for w in own if rng.random() > 1 / len(own)]
        texts += [b" ".join([b"before", *own, b"after"]).decode(), b" ".join(broken).decode()]
    got = {r.doc_id: set(filter(None, r.labels.split(","))) - set(filter(None, r.base_labels.split(","))) for r in license_digest(scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, text in enumerate(texts):
        base = set(filter(None, brute(i, text)[5].split(",")))
        assert got[i] == slow_labels(words(text.encode())) - base, text
    own = [a for each in compiled().values() for a in each]
    assert len(own) == len(TEMPLATES) and all(places(a, words(texts[0].encode())) is not None for a in own)


def test_a_longer_wording_wins(spark):
    two = re.sub(r"\[\[.*?\]\]", " ", next(w for label, _, w in TEMPLATES if label == "bsd-2-clause"), flags=re.S)
    names = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert digest(spark, two).labels == "bsd-2-clause" and digest(spark, f"{two} {names}").labels == "bsd-3-clause"


def test_standard_notices(spark):
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}."
    later = "either version 3 of the License, or (at your option) any later version"
    assert digest(spark, notice.format("General Public License", later)).labels == "gpl,gpl-3.0-or-later"
    assert digest(spark, notice.format("General Public License", "version 2 of the License")).labels == "gpl,gpl-2.0"
    assert digest(spark, notice.format("Affero General Public License", later)).labels == "agpl-3.0-or-later,gpl"
    assert digest(spark, notice.format("Lesser General Public License", later.replace("3", "2.1"))).labels == "gpl,lgpl-2.1-or-later"
    assert digest(spark, "subject to the terms of the Mozilla Public License, v. 2.0").labels == ""
    assert digest(spark, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.").labels == "mpl-2.0"
    assert digest(spark, "SPDX-License-Identifier: LGPL-3.0-or-later").labels == "lgpl-3.0-or-later"
