"""License scans by template-markup matching.

A template is wording with two kinds of markup: [[...]] may be left out, {{n}} stands for up to n words of any kind.
It is compiled to an automaton over words; a text is accepted where a run of its words spells all mandatory wording
exactly. Automata start only in documents that hold a template's key word (which its wording demands), at places
where its first words stand. Where one template's place lies inside a longer one's, only the longer counts, so a license
that goes on from another's wording isn't taken for it. Base phrases are found beside the templates and are always reported.

The templates are the standard notices, headers and openings of the licenses in TEMPLATES and SPDX_IDS; README lists them.

Defined cases: null text is empty; empty and wordless texts have no places and score 0; very long texts are scanned whole; a
template's own places don't overlap (the leftmost, then the longest is taken), and two templates that accept the same run both
count; repeated rows are each scanned; an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, per_process, quoted, texts_of, to_arrow_schema
from .words import words

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted [[(subject to the limitations in the
disclaimer below)]] provided that the following conditions are met: [[1.]] [[*]] Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """ [[3.]] Neither the name of {{12}} nor the names of [[its]] [[their]] [[the]] contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """ [[THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.]]"""
_FSF = """free software[[;]] you can redistribute it and/or modify it under the terms of the GNU {name} [[(GPL)]] [[(LGPL)]] as published by the
Free Software Foundation[[,]] {version} [[{{{{8}}}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.]] [[See the GNU {name} for more details.]] [[You should have received a
copy of the GNU {name} along with {{{{4}}}}]]"""
_FSF_TITLE = """GNU {name} Version {number}, {date} Copyright (C) {years} Free Software Foundation, Inc. {{{{16}}}} Everyone is permitted to copy
and distribute verbatim copies of this license document, but changing it is not allowed."""
#: Licenses of the Free Software Foundation as (label, name, version, date, years).
_FSF_LICENSES = (
    ("gpl-2.0", "General Public License", "2", "June 1991", "1989, 1991"),
    ("gpl-3.0", "General Public License", "3", "29 June 2007", "2007"),
    ("lgpl-2.0", "Library General Public License", "2", "June 1991", "1991"),
    ("lgpl-2.1", "Lesser General Public License", "2.1", "February 1999", "1991, 1999"),
    ("lgpl-3.0", "Lesser General Public License", "3", "29 June 2007", "2007"),
    ("agpl-3.0", "Affero General Public License", "3", "19 November 2007", "2007"),
)
#: Creative Commons licenses as (label, code, name).
_CC_LICENSES = (
    ("cc-by-4.0", "BY", "Attribution"),
    ("cc-by-sa-4.0", "BY-SA", "Attribution-ShareAlike"),
    ("cc-by-nd-4.0", "BY-ND", "Attribution-NoDerivatives"),
    ("cc-by-nc-4.0", "BY-NC", "Attribution-NonCommercial"),
    ("cc-by-nc-sa-4.0", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-nd-4.0", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
#: Identifiers that a file may name after "SPDX-License-Identifier:".
SPDX_IDS = ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")

#: (label, key word, wording). Public license texts and notices; case and punctuation don't matter.
TEMPLATES = (
    ("mit", "sublicense", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the [["]]Software[["]]), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be
included in all copies or substantial portions of the Software. [[THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
{{8}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.]]"""),
    ("mit", "mit", "{{1}} under the [[terms of the]] MIT License"),
    ("isc", "granted", """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-2-clause", "redistributions", _BSD + _BSD_END),
    ("bsd-3-clause", "redistributions", _BSD + _BSD_NAMES + _BSD_END),
    ("apache-2.0", "apache", """Licensed under the [[terms of the]] Apache License, [[Version]] 2.0 [[(the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at]] [[http://www.apache.org/licenses/LICENSE-2.0]]
[[https://www.apache.org/licenses/LICENSE-2.0]] [[Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.]] [[See the License for the specific
language governing permissions and limitations under the License.]]"""),
    ("apache-2.0", "apache", """Apache License Version 2.0, January 2004 [[http://www.apache.org/licenses/]] [[https://www.apache.org/licenses/]] TERMS AND
CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and
distribution as defined by Sections 1 through 9 of this document."""),
    ("gpl-3.0", "gnu", "licensed under the [[terms of the]] GNU General Public License, [[version]] [[v]] 3"),
    ("gpl-2.0", "gnu", "licensed under the [[terms of the]] GNU General Public License, [[version]] [[v]] 2"),
    *((label + end, "gnu", _FSF.format(name=name, version=wording.format(number)))
      for label, name, number, _, _ in _FSF_LICENSES
      for end, wording in (("", "version {} of the License"), ("", "version {}"), ("-or-later", "either version {} of the License, or (at your option) any later version"))),
    *((label, "gnu", _FSF_TITLE.format(name=name, number=number, date=date, years=years)) for label, name, number, date, years in _FSF_LICENSES),
    ("mpl-2.0", "mozilla", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. [[If a copy of the MPL was not distributed
with this file, You can obtain one at]] [[http://mozilla.org/MPL/2.0/]] [[https://mozilla.org/MPL/2.0/]]"""),
    ("mpl-2.0", "mozilla", """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates,
contributes to the creation of, or owns Covered Software."""),
    ("epl-2.0", "eclipse", """made available under the terms of the Eclipse Public License [[v.]] [[version]] 2.0 [[which is available at
https://www.eclipse.org/legal/epl-2.0]]"""),
    ("bsl-1.0", "boost", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1.0", "granted", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software"""),
    ("zlib", "authors", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
    ("unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", "waived", "To the extent possible under law, {{12}} waived all copyright and related or neighboring rights to"),
    *((label, "cc", f"Licensed under [[a]] [[Creative Commons]] [[the]] CC {code} 4.0") for label, code, _ in _CC_LICENSES),
    *((label, "creative", f"Licensed under [[a]] [[the]] Creative Commons {name} 4.0 [[International]] [[License]]") for label, _, name in _CC_LICENSES),
    *((name.lower() + end, "spdx", f"SPDX-License-Identifier: {name}{mark}") for name in SPDX_IDS for end, mark in ((("", ""), ("", "-only"), ("-or-later", "-or-later")) if "GPL" in name else (("", ""),))),
)

FOUND = T.StructType().add("label", "string").add("start", "long").add("end", "long")
OUT = T.StructType().add("doc_id", "long").add("n_words", "long").add("base", T.ArrayType(FOUND)).add("templates", T.ArrayType(FOUND))
_MARK = re.compile(r"\[\[(?P<optional>.*?)\]\]|\{\{(?P<any>\d+)\}\}|(?P<plain>[^\[{]+|[\[{])", re.S)


class Automaton:
    """States are numbered; step[s] maps a word to the next state, free[s] is the state after any word, skips[s] states without one."""

    def __init__(self, label: str, key: str, wording: str):
        self.label, self.key = label, key.encode()
        self.step: list[dict[bytes, int]] = [{}]
        self.free: list[int | None] = [None]
        self.skips: list[list[int]] = [[]]
        for m in _MARK.finditer(wording):
            if m["any"]:
                starts = []
                for _ in range(int(m["any"])):
                    at = len(self.step) - 1
                    starts.append(at)
                    self._state()
                    self.free[at] = at + 1
                for at in starts:
                    self.skips[at].append(len(self.step) - 1)
            elif m["optional"] is not None:
                before = len(self.step) - 1
                inner = Automaton(label, key, m["optional"])
                for s in range(len(inner.step) - 1):
                    self._state()
                    self.step[before + s] = {w: before + t for w, t in inner.step[s].items()}
                    self.free[before + s] = None if inner.free[s] is None else before + inner.free[s]
                    self.skips[before + s] += [before + t for t in inner.skips[s]]
                if len(self.step) - 1 > before:
                    self.skips[before].append(len(self.step) - 1)
            else:
                for w in words(m["plain"].encode()):
                    self._state()
                    self.step[-2][w] = len(self.step) - 1
        self.end = len(self.step) - 1
        first = self._closed({0})
        self.first = None if any(self.free[s] is not None for s in first) else {w for s in first for w in self.step[s]}

    def _state(self) -> None:
        self.step.append({})
        self.free.append(None)
        self.skips.append([])

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, text: list[bytes], start: int) -> int | None:
        """Where the longest accepted run from start ends (exclusive), if one is accepted."""
        now, best = self._closed({0}), None
        for at in range(start, len(text)):
            w = text[at]
            now = self._closed({t for s in now for t in (self.step[s].get(w), self.free[s]) if t is not None})
            if not now:
                break
            if self.end in now:
                best = at + 1
        return best


def compiled() -> dict[bytes, list[Automaton]]:
    """Automata by key word."""

    def make():
        out: dict[bytes, list[Automaton]] = {}
        for t in TEMPLATES:
            a = Automaton(*t)
            out.setdefault(a.key, []).append(a)
        return out

    return per_process("license-automata", make)


def places(a: Automaton, text: list[bytes]) -> list[tuple[str, int, int]]:
    """Where an automaton accepts, from the left, without overlaps. One that may begin with any word begins one before or at its own."""
    if a.first is not None:
        starts = [i for i, w in enumerate(text) if w in a.first]
    else:
        starts = sorted({i - k for i, w in enumerate(text) if w in a.step[1] for k in (0, 1) if i >= k})
    out, end = [], -1
    for i in starts:
        if i >= end and (z := a.match(text, i)) is not None:
            out.append((a.label, i, z))
            end = z
    return out


def scan_words(text: list[bytes], lowered: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Places of base phrases and of templates, as (label, first word, word after the last)."""
    base, found = [], []
    if b"license" in lowered:
        for label, phrase in PHRASES.items():
            want = [w.encode() for w in phrase.split()]
            last = len(want) - 1
            base += [(label, i - last, i + 1) for i, w in enumerate(text) if w == want[-1] and i >= last and text[i - last : i + 1] == want]
    for key, own in compiled().items():
        if key in lowered and key in text:
            for a in own:
                found += places(a, text)
    inside = lambda x: any(a <= x[1] and x[2] <= z and z - a > x[2] - x[1] for _, a, z in found)
    kept = {x for x in found if not inside(x)}
    return sorted(base, key=lambda x: (x[1], x[0])), sorted(kept, key=lambda x: (x[1], x[0], x[2]))


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    form = lambda places: [{"label": k, "start": a, "end": z} for k, a, z in places]
    for batch in chunks(batches):
        n, base, found = [], [], []
        for text in texts_of(batch.column("text")):
            own = words(text)
            n.append(len(own))
            b, f = scan_words(own, text.lower())
            base.append(form(b))
            found.append(form(f))
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, schema.field("base").type), pa.array(found, schema.field("templates").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, and the places of base phrases and of templates."""
    schema = to_arrow_schema(OUT)
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return slim.mapInArrow(lambda it: _scan(it, schema), OUT)


def license_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1: a template's wording is met; 0.5: a base phrase only)."""
    joined = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    size = lambda c: F.size(c).cast("long")
    score = F.when(F.size("templates") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0)
    return found.select("doc_id", "n_words", size("base").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"), joined("base.label").alias("base_labels"), joined("base.label", "templates.label").alias("labels"), score.alias("score"))
