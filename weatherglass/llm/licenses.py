"""License scans by patience alignment.

Words are those of the decontamination operator (A-Z lower-cased, runs of digits, letters and non-ASCII characters). A
license occurs where a window of a text, 1.25 times and 3 words as long as the template, aligns with it with a coverage
(aligned words over the template's words) of at least COVERAGE. Alignment: equal words at both ends are matched; then the
words that occur once in the window and once in the template, and in the longest increasing subsequence of their places, are
anchors; the gaps between anchors are aligned in the same way, within which other words are unique. Windows are tried where
they hold enough of the template's words for that coverage (no other window can reach it), from left to right. Of windows that
begin inside a match the one with most aligned words counts (of equal ones that whose match is shorter, then the first), so
matches don't overlap and none is cut short by a window that began too early.

Members of a family share most of their words. What tells them apart stands in braces in a template: these words must be
aligned, one right behind the other, so that "GNU Lesser General Public License" is no "GNU General Public License", and version
2 no version 3. Of a short template (below NOTICE words), a word that denies it may stand neither in the match nor among the
DENIED_WITHIN words before it. Behind the tag of SPDX the identifiers are read: spdx:mit, or spdx:mit or apache-2.0; an
unknown one is spdx.

Null and empty texts have no license. Repeated rows are kept, each with its result. Columns beside doc_id and text are
ignored. A template that equals a part of another is found beside it; the best match is the one with most aligned words, ties
to the smaller name. Texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare, utf8
from .decontamination import words_of

COVERAGE, STRETCH, SLACK = 0.8, 1.25, 3
NOTICE, DENIED_WITHIN = 25, 2
#: Words that deny a notice (fixed list).
DENIALS = "not never isn aren wasn neither nor without longer unlike".split()

_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the {{GNU {0}General Public License}} as
        published by the Free Software Foundation, either {{version {1}}} of the License, or (at your option) any later version. This program is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the {{GNU {0}General Public License}} for more details."""
_FSF = "{{GNU {0}GENERAL PUBLIC LICENSE Version {1}}}, {2} Copyright (C) {3} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_BSD = """{0}Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. {1}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to {endorse or promote products} derived from this software without specific prior written permission. "

#: Notices, headers and texts of common licenses (fixed values); in braces what tells the members of a family apart.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the {Apache License, Version 2}.0.",
    "cc-by-4.0-notice": "Licensed under {CC BY 4.0}.",
    "cc-by-nc-4.0-notice": "Licensed under {CC BY-NC 4.0}.",
    "cc-by-nc-nd-4.0-notice": "Licensed under {CC BY-NC-ND 4.0}.",
    "cc-by-nc-sa-4.0-notice": "Licensed under {CC BY-NC-SA 4.0}.",
    "cc-by-nd-4.0-notice": "Licensed under {CC BY-ND 4.0}.",
    "cc-by-sa-4.0-notice": "Licensed under {CC BY-SA 4.0}.",
    "cc-by-4.0-header": "This work is licensed under a Creative Commons {Attribution 4.0 International} License.",
    "cc-by-nc-4.0-header": "This work is licensed under a Creative Commons {Attribution-NonCommercial 4.0 International} License.",
    "cc-by-nc-sa-4.0-header": "This work is licensed under a Creative Commons {Attribution-NonCommercial-ShareAlike 4.0 International} License.",
    "cc-by-sa-4.0-header": "This work is licensed under a Creative Commons {Attribution-ShareAlike 4.0 International} License.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under {CC0 1.0}.",
    "agpl-3.0-notice": "This work is licensed under the {GNU Affero General Public License, version 3}.",
    "gpl-2.0-notice": "This work is licensed under the {GNU General Public License, version 2}.",
    "gpl-3.0-notice": "This work is licensed under the {GNU General Public License, version 3}.",
    "lgpl-2.1-notice": "This work is licensed under the {GNU Lesser General Public License, version 2.1}.",
    "lgpl-3.0-notice": "This work is licensed under the {GNU Lesser General Public License, version 3}.",
    "bsd-2-clause-notice": "Released under the {BSD 2-Clause} License.",
    "bsd-3-clause-notice": "Released under the {BSD 3-Clause} License.",
    "mit-notice": "Released under the {MIT License}.",
    "mpl-2.0-notice": "This work is licensed under the {Mozilla Public License, version 2}.0.",
    "apache-2.0-header": """Licensed under the {Apache License, Version 2}.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
        or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "agpl-3.0-header": _GPL.format("Affero ", "3"),
    "gpl-2.0-header": _GPL.format("", "2"),
    "gpl-3.0-header": _GPL.format("", "3"),
    "lgpl-2.1-header": _GPL.format("Lesser ", "2.1"),
    "lgpl-3.0-header": _GPL.format("Lesser ", "3"),
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2}.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "agpl-3.0-text": _FSF.format("AFFERO ", "3", "19 November 2007", "2007"),
    "apache-2.0-text": "{Apache License Version 2}.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    "gpl-2.0-text": _FSF.format("", "2", "June 1991", "1989, 1991"),
    "gpl-3.0-text": _FSF.format("", "3", "29 June 2007", "2007"),
    "lgpl-2.1-text": _FSF.format("LESSER ", "2.1", "February 1999", "1991, 1999"),
    "lgpl-3.0-text": _FSF.format("LESSER ", "3", "29 June 2007", "2007"),
    "mpl-2.0-text": "{Mozilla Public License Version 2}.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "bsd-2-clause": _BSD.format("", "").replace("in source and binary forms", "in {source and binary forms}").replace("provided with the distribution. THIS", "provided with the {distribution. THIS}"),
    "bsd-3-clause": _BSD.format("", _THIRD).replace("in source and binary forms", "in {source and binary forms}"),
    "isc": """{Permission to use, copy, modify, and/or distribute this software} for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "spdx": "{SPDX-License-Identifier}:",
    "unlicense": "This is free and unencumbered software {released into the public domain}. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. {Permission is granted to anyone to use this software for any purpose}, including commercial applications, and to
        alter it and redistribute it freely.""",
}

#: Identifiers of SPDX that are read behind its tag (fixed values), and the words that join them.
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 "
    "CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LLVM-exception MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Unicode-3.0 "
    "Unlicense UPL-1.0 W3C WTFPL Zlib").split()
JOINTS = ("or", "and", "with")


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by piles of patience sorting."""
    tops: list[int] = []
    held: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        back.append(held[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            held.append(i)
        else:
            tops[k], held[k] = p, i
    out, i = [], held[-1] if held else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of aligned words, in order."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            pairs.append((m, n))
        if i == m or j == n:
            continue
        once: dict[int, int] = {}
        for k in range(i, m):
            once[a[k]] = -1 if a[k] in once else k
        there: dict[int, int] = {}
        for k in range(j, n):
            there[b[k]] = -1 if b[k] in there else k
        both = [(x, there[w]) for w, x in once.items() if x >= 0 and there.get(w, -1) >= 0]
        both.sort()
        anchors = [both[k] for k in increasing([y for _, y in both])]
        if not anchors:
            continue
        pairs += anchors
        for (x, y), (x2, y2) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
            todo.append((x + 1, x2, y + 1, y2))
    return sorted(pairs)


@dataclass
class Template:
    name: str
    words: list[int]
    runs: list[list[int]]  # places of words that must be aligned one behind the other
    width: int
    least: int

    def holds(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether aligned words are enough, and all that must be are among them."""
        if len(pairs) < self.least:
            return False
        at = dict(pairs)
        return all(run[0] in at and all(at.get(k, -1) == at[run[0]] + i for i, k in enumerate(run)) for run in self.runs)


class Templates:
    def __init__(self, texts: dict[str, str], coverage: float = COVERAGE):
        self.symbols: dict[bytes, int] = {}
        self.known: list[Template] = []
        for name, text in sorted(texts.items()):
            ids: list[int] = []
            runs: list[list[int]] = []
            for k, part in enumerate(re.split("[{}]", text)):
                own = self.coded(part)
                if k % 2 and own:
                    runs.append(list(range(len(ids), len(ids) + len(own))))
                ids += own
            if ids:
                self.known.append(Template(name, ids, runs, int(len(ids) * STRETCH) + SLACK, max(1, int(np.ceil(coverage * len(ids) - 1e-9)))))
        self.denials = set(self.coded(" ".join(DENIALS)))
        self.joints = dict(zip(self.coded(" ".join(JOINTS)), JOINTS, strict=True))
        self.identifiers = {tuple(self.coded(x)): x.lower() for x in IDENTIFIERS}
        self.longest = max(map(len, self.identifiers))

    def coded(self, text: str) -> list[int]:
        return [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words_of(text.encode())]

    def identified(self, words: list[int]) -> tuple[str, int]:
        """The identifiers at the beginning of words, joined, and how many words they take."""
        out, at, joint = "", 0, ""
        while True:
            k = next((k for k in range(min(self.longest, len(words) - at), 0, -1) if tuple(words[at : at + k]) in self.identifiers), 0)
            if not k:
                return out, at - bool(joint)
            out += joint + self.identifiers[tuple(words[at : at + k])]
            at += k
            if at == len(words) or words[at] not in self.joints:
                return out, at
            joint = f" {self.joints[words[at]]} "
            at += 1

    def scan(self, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[str, float, int, int, int]]]]:
        """Words of each text, and its matches (name, coverage, first word, end word, aligned words)."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        out: list[list] = [[] for _ in texts]
        get = self.symbols.get
        coded = np.fromiter(chain.from_iterable(chain(map(get, w, repeat(0)), (0,)) for w in words), np.int32, int(sizes.sum()) + len(texts))
        counts = np.bincount(coded, minlength=len(self.symbols) + 1)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        ends = starts + sizes
        for t in self.known:
            needed = sorted({t.words[k] for run in t.runs for k in run}, key=lambda w: counts[w])
            if needed and not counts[needed[0]]:
                continue
            inside = np.zeros(len(self.symbols) + 1, bool)
            inside[t.words] = True
            held = inside[coded]
            total = np.concatenate(([0], np.cumsum(held)))
            last = np.minimum(np.arange(len(coded)) + t.width, len(coded))
            tried = held & (total[last] - total[:-1] >= t.least)
            for w in needed[:2]:  # the rarest words that every match holds
                total = np.concatenate(([0], np.cumsum(coded == w)))
                tried &= total[last] > total[:-1]
            tried = np.flatnonzero(tried)

            def match(at: int, stop: int, t: Template = t):
                pairs = patience(t.words, coded[at : min(at + t.width, stop)].tolist())
                if not t.holds(pairs):
                    return None
                return -len(pairs), pairs[-1][1] - pairs[0][1], at + pairs[0][1], at + pairs[-1][1] + 1, [at + y for _, y in pairs]

            k = 0
            while k < len(tried):
                at = int(tried[k])
                d = int(np.searchsorted(starts, at, side="right")) - 1
                best = match(at, int(ends[d]))
                k += 1
                if best is None:
                    continue
                while k < len(tried) and tried[k] < best[3] and -best[0] < len(t.words):
                    more = match(int(tried[k]), int(ends[d]))
                    best = min(best, more) if more else best
                    k += 1
                k = int(np.searchsorted(tried, best[3], side="left"))
                if len(t.words) < NOTICE and not self.denials.isdisjoint(set(coded[max(int(starts[d]), best[2] - DENIED_WITHIN) : best[3]].tolist()) - set(coded[best[4]].tolist())):
                    continue
                name, more = t.name, 0
                if name == "spdx":
                    told, more = self.identified(coded[best[3] : min(best[3] + 64, int(ends[d]))].tolist())
                    name = f"spdx:{told}" if told else name
                out[d].append((name, -best[0] / len(t.words), int(best[2] - starts[d]), int(best[3] - starts[d]) + more, -best[0]))
        return sizes.tolist(), out


SCHEMA = "doc_id long, n_words long, n_matches long, license string, coverage double, matched_words long, matches array<struct<license: string, coverage: double, first: long, end: long>>"


def scan(documents: DataFrame, *, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per document (doc_id, text): its words, all license matches (spans in words) and the best one."""
    spark = prepare(documents.sparkSession)
    known = spark.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, coverage))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))]

    def run(batches):
        for batch in batches:
            texts, rows = utf8(batch.column(1)), []
            for a, b in chunks(texts):
                for n, matches in zip(*known.value.scan(texts[a:b]), strict=True):
                    best = min(matches, key=lambda m: (-m[4], m[0]), default=None)
                    rows.append((n, len(matches), best and best[0], best and best[1], best[4] if best else 0, [dict(zip(("license", "coverage", "first", "end"), m[:4], strict=True)) for m in matches]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_words", "n_matches", "license", "coverage", "matched_words", "matches"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_matches", "license", "coverage", "matched_words")
