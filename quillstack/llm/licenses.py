"""License scan by patience alignment.

Template and text are compared as lower-cased words.  Words that occur once in
the template and once in the text span are anchors; the longest increasing
subsequence of their positions is kept, and every gap between two anchors is
aligned the same way, after taking its common beginning and end.  Coverage is
the share of the template's words that end up matched.

A match covers ``LEAST`` of the template's words inside twice its length, so that
a word may stand between each two, and holds the template's deciding words: one
word is all that tells many short notices apart.  A foreign word inside it (as
``Lesser`` in the GPL's notice) makes it another license's.

Every text is looked at.  Stretches to align are those with so many of a
template's telling words that a match is possible: a match misses a fifth of the
words, so the rest of the telling words must be there.  Scanning is one map over
the documents with fixed templates, each of which must contain a trigger, a
string that tells a notice.

Defined cases: null, empty or blank texts have no match; overlapping matches
leave the one with more matched words, then the earlier template; repeated
matches of a license are reported each; version numbers are compared without
ending zeros; other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

LEAST = 0.8
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
_VERSION = re.compile(r"\bv?(\d+)(?:\.0)+\b|\bv(\d+(?:\.\d+)*)\b")

#: Public license notices: id and text.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."),
    ("BSD", "Released under the BSD License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("all-rights-reserved", "All rights reserved."),
)
#: Creative Commons forms: code and name; each makes three notices of version 4.0 and three of 3.0.
COMMONS = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
TEMPLATES += tuple(
    (f"CC-{code}-{version}", text)
    for version, scope in (("4.0", "International"), ("3.0", "Unported"))
    for code, name in COMMONS
    for text in (f"Licensed under CC {code} {version}.", f"This work is licensed under a Creative Commons {name} {version} {scope} License.", f"{name} {version} {scope}")
)
TRIGGERS = ("licen", "copyright", "permission", "rights reserved", "redistribut", "public domain", "attribution")
#: Words that tell a license's notices from others of the same build, where a notice has them: a match must hold them.
DECIDING = {
    "MIT": "mit", "Apache-2.0": "apache 2", "GPL-3.0": "gnu 3", "GPL-2.0": "gnu 2", "LGPL-3.0": "gnu lesser 3", "LGPL-2.1": "gnu lesser 2.1", "AGPL-3.0": "gnu affero 3",
    "MPL-2.0": "mozilla 2", "EPL-2.0": "eclipse 2", "BSD": "bsd", "BSL-1.0": "boost 1", "Unlicense": "unencumbered", "CC0-1.0": "dedicated domain", "all-rights-reserved": "rights reserved",
} | {f"CC-{code}-{version}": f"{code} {name} {version[0]}".lower() for version in ("4.0", "3.0") for code, name in COMMONS}
#: Words that, put into a notice, make it another license's.
_MORE = {"nc": "nc noncommercial non-commercial", "sa": "sa sharealike share-alike", "nd": "nd noderivatives noderivs no-derivatives"}
FOREIGN = {"GPL-3.0": "lesser library affero", "GPL-2.0": "lesser library affero", "MIT": "no attribution", "BSD": "2-clause 3-clause 4-clause"} | {
    f"CC-{code}-{version}": " ".join(words for part, words in _MORE.items() if part not in code.lower().split("-")) for version in ("4.0", "3.0") for code, _ in COMMONS
}
#: Words of any prose; they begin no search.
_COMMON = frozenset("a an and any are as at be by for from in is it its no not of on or that the this to with you will all".split())


def words_of(text: str) -> list[str]:
    """Lower-case words; of version numbers, marks and ending zeros are cut: v2.0 and 2.0 are 2."""
    return _WORD.findall(_VERSION.sub(r"\1\2", text.lower()))


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops, places, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = places[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            places.append(i)
        else:
            tops[pile], places[pile] = v, i
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        in_a, in_b = Counter(a[i:n]), Counter(b[j:m])
        place = {w: k for k, w in enumerate(b[j:m], j) if in_b[w] == 1}
        anchors = [(k, place[w]) for k, w in enumerate(a[i:n], i) if in_a[w] == 1 and w in place]
        anchors = [anchors[k] for k in longest_increasing([y for _, y in anchors])]
        if not anchors:
            continue
        out += anchors
        edges = [(i - 1, j - 1), *anchors, (n, m)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(out)


@dataclass
class Template:
    license: str
    words: list[str]
    least: float = LEAST

    def __post_init__(self):
        n = len(self.words)
        self.need = ceil(self.least * n - 1e-9)
        self.must = Counter(w for w in self.words if w in DECIDING.get(self.license, "").split())
        self.foreign = frozenset(FOREIGN.get(self.license, "").split()).difference(self.words)
        # words that begin a search: a match misses n - need words at most, so it holds some of these
        rare = [w for w in dict.fromkeys(self.words) if w not in _COMMON]
        every = Counter(self.words)
        for w in every:
            if w in _COMMON and sum(every[x] for x in rare) <= n - self.need:
                rare.append(w)
        self.tell = {w: every[w] for w in rare}
        self.some = sum(self.tell.values()) - (n - self.need)
        self.span = 2 * n + 2
        places = [i for i, w in enumerate(self.words) if w in self.tell]
        self.lead, self.tail = places[0], n - 1 - places[-1]
        self.place = {w: self.words.index(w) for w in self.tell}

    def stretch(self, hits: list[tuple[int, str]], lo: int, hi: int) -> tuple[int, int] | None:
        """The first stretch of the words from ``lo`` to ``hi`` that may hold the template, given the sorted places of its telling words: those of it that count, by their number in the template, are enough."""
        inside: Counter = Counter()
        count, tail = 0, bisect_left(hits, (lo,))
        best: tuple[int, int, int] | None = None
        for k in range(tail, bisect_left(hits, (hi,))):
            p, w = hits[k]
            if best and p - best[1] > self.span:
                break
            inside[w] += 1
            count += inside[w] <= self.tell[w]
            while hits[tail][0] < p - self.span:
                old = hits[tail][1]
                count -= inside[old] <= self.tell[old]
                inside[old] -= 1
                tail += 1
            if count >= self.some and (best is None or count > best[0]):
                best = (count, hits[tail][0], p + 1)
        return best and best[1:]

    def align(self, words: list[str], found: tuple[int, int], floor: int, hi: int) -> list[tuple[int, int]]:
        """The most matched pairs of the template against the stretch, taken tight, with its ends, and with room for a word between each two."""
        first = found[0] - self.place[words[found[0]]]
        best: list[tuple[int, int]] = []
        for start, end in ((first, first + len(self.words)), (first - 2, found[1] + self.tail + 2), (found[0] - 2 * self.lead - 2, found[0] + self.span)):
            start = max(floor, start)
            pairs = [(i, start + j) for i, j in patience(self.words, words[start : min(hi, end)])]
            if len(pairs) > len(best):
                best = pairs
            if len(best) == len(self.words):
                break
        return best

    def fits(self, words: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Enough words are matched, among them all deciding ones, and no word of another license stands between them."""
        if len(pairs) < self.need or self.must - Counter(self.words[i] for i, _ in pairs):
            return False
        return not self.foreign or self.foreign.isdisjoint(words[pairs[0][1] : pairs[-1][1] + 1])

    def search(self, words: list[str], where: dict[str, list[int]]) -> Iterator[list[tuple[int, int]]]:
        """Matched places (in the template, in ``words``) of each match; the words before and after a match are searched again."""
        if sum(min(n, len(where.get(w, ()))) for w, n in self.tell.items()) < self.some:
            return
        hits = sorted((p, w) for w in self.tell for p in where.get(w, ()))
        todo = [(0, 0, len(words))]  # hits from, words from, both up to
        while todo:
            lo, floor, hi = todo.pop()
            if not (found := self.stretch(hits, lo, hi)):
                continue
            pairs = self.align(words, found, floor, hi)
            if self.fits(words, pairs):
                yield pairs
                first, after = pairs[0][1], pairs[-1][1] + 1
                todo += [(after, after, hi), (lo, floor, first)]
            else:
                todo.append((found[0] + 1, floor, hi))


def scan(text: str | None, templates: list[Template]) -> list[dict]:
    """Matches in one text: license, first and last word, matched words, coverage."""
    words = words_of(text or "")
    wanted = set().union(*(t.tell for t in templates))
    where: dict[str, list[int]] = {}
    for p, w in enumerate(words):
        if w in wanted:
            where.setdefault(w, []).append(p)
    found = []
    for t in templates if where else ():
        for pairs in t.search(words, where):
            found.append({"license": t.license, "first": pairs[0][1], "last": pairs[-1][1], "matched": len(pairs), "coverage": len(pairs) / len(t.words)})
    kept: list[dict] = []
    for m in sorted(found, key=lambda m: (-m["matched"], m["first"])):
        if all(m["last"] < k["first"] or m["first"] > k["last"] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m["first"])


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))
_DDL = "array<struct<license:string,first:bigint,last:bigint,matched:bigint,coverage:double>>"


def matches(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, licenses): the matches in every row's text."""
    ready = [Template(name, words_of(text), least) for name, text in templates]
    for name, text in templates:
        if not any(t in text.lower() for t in TRIGGERS):
            raise ValueError(f"template {name} has no trigger")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t.as_py(), ready) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _FOUND)], names=["doc_id", "licenses"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, licenses {_DDL}")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, licenses (names in text order), coverage (largest) of every document."""
    found = matches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.transform("licenses", lambda m: m["license"]).alias("licenses"), F.array_max(F.transform("licenses", lambda m: m["coverage"])).alias("coverage"))
