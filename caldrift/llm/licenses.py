"""License scans by patience alignment.

A text and a template are aligned on the words that each holds exactly once, in the longest increasing run of those
pairs; the gaps between them are aligned in the same way, down to gaps without such words. Coverage is the share of a template's words
that the alignment pairs. Words outside a template can't be paired, so only the text's words that some template has are
kept, and windows whose words could not reach the coverage are left unaligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as T

LEAST_COVERAGE = 0.8
#: Words of a text in which a notice must lie, for each word of the template.
SLACK = 2
#: Notices and characteristic passages of common licenses, in the order in which equal coverage is decided.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-body": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-body": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0-body": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "MPL-2.0-body": "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions",
    "GPL-body": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "LGPL-3.0-body": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
}
#: Words of a template that name its license: all must be among the pairs.
NAMED = {
    "MIT": "mit",
    "Apache-2.0": "apache 2.0",
    "GPL-3.0": "gnu general 3",
    "BSD-3-Clause": "bsd-style",
    "MPL-2.0": "mozilla 2.0",
    "CC-BY-4.0": "creative commons attribution 4.0",
    "Apache-2.0-header": "apache 2.0",
    "MIT-grant": "charge deal restriction",
    "ISC-grant": "fee",
    "BSD-body": "redistribution binary",
    "BSD-3-Clause-body": "neither endorse",
    "Apache-2.0-body": "contributor perpetual irrevocable",
    "MPL-2.0-body": "contributor licensable exploit",
    "GPL-body": "gnu general copyleft",
    "LGPL-3.0-body": "gnu lesser 3",
}
#: Words that make a notice another license's when they stand inside it.
BARRED = {"GPL-3.0": "lesser affero", "GPL-body": "lesser affero"}
_CC = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
for _kind in ("", "-nc", "-sa", "-nd", "-nc-sa", "-nc-nd"):
    for _version in ("4.0", "3.0"):
        _name = f"CC-BY{_kind.upper()}-{_version}"
        _long = "-".join(["Attribution", *[_CC[x] for x in _kind.split("-")[1:]]])
        _tail = "International" if _version == "4.0" else "Unported"
        TEMPLATES[f"{_name}-short"], NAMED[f"{_name}-short"] = f"Licensed under CC BY{_kind.upper()} {_version}.", f"cc by{_kind} {_version}"
        if _name not in TEMPLATES:
            TEMPLATES[_name], NAMED[_name] = f"This work is licensed under a Creative Commons {_long} {_version} {_tail} License.", f"creative commons {_long.lower()} {_version}"
for _kind, _versions in (("General", ("2", "3")), ("Lesser General", ("2.1", "3")), ("Affero General", ("3",))):
    for _version in _versions:
        _name = f"{''.join(x[0] for x in _kind.split() if x != 'General')}GPL-{_version if '.' in _version else _version + '.0'}"
        _of = f"the GNU {_kind} Public License"
        _words = f"gnu {_kind.lower()} {_version}"
        TEMPLATES[f"{_name}-header"] = f"you can redistribute it and/or modify it under the terms of {_of} as published by the Free Software Foundation, either version {_version} of the License, or (at your option) any later version."
        NAMED[f"{_name}-header"] = _words
        if _name not in TEMPLATES:
            TEMPLATES[_name], NAMED[_name] = f"This work is licensed under {_of}, version {_version}.", _words
        if _kind == "General":
            BARRED[_name] = BARRED[f"{_name}-header"] = "lesser affero library"
TEMPLATES["ISC"], NAMED["ISC"] = "Released under the ISC License.", "isc"
TEMPLATES["BSD"], NAMED["BSD"] = "Released under the BSD License.", "bsd"
#: Whole texts of short licenses.
_AS_IS = "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ' + _AS_IS
TEMPLATES["MIT-text"] = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
TEMPLATES["ISC-text"] = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEMPLATES["BSD-2-Clause-text"] = f"{_BSD} {_BSD_END}"
TEMPLATES["BSD-3-Clause-text"] = f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"
NAMED["BSD-3-Clause-text"], BARRED["BSD-2-Clause-text"] = "neither endorse promote", "endorse promote"
NAMED["MIT-text"], NAMED["ISC-text"], NAMED["BSD-2-Clause-text"] = "sublicense noninfringement", "fee disclaims", "redistribution binary disclaimer"
_STRIP = b".,;:!?'\"()[]{}<>*#$%&|"


def normal(word: bytes) -> bytes:
    return word.strip(_STRIP).lower()


def words_of(text: str) -> list[bytes]:
    return [x for w in text.split() if (x := normal(w.encode()))]


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing run, by patience piles."""
    tops: list[int] = []
    pile: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k:
            before[i] = pile[k - 1]
        tops[k : k + 1], pile[k : k + 1] = [v], [i]
    out, at = [], pile[-1] if pile else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Paired places of equal words, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if right[w] == 1 and left[w] == 1}
        pairs = [(k, place[w]) for k, w in enumerate(text[a:b], a) if w in place]
        anchors = [pairs[k] for k in increasing([y for _, y in pairs])]
        if not anchors:
            continue
        lo_a, lo_c = a, c
        for x, y in anchors:
            todo.append((lo_a, x, lo_c, y))
            out.append((x, y))
            lo_a, lo_c = x + 1, y + 1
        todo.append((lo_a, b, lo_c, d))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE, named: dict[str, str] | None = None, barred: dict[str, str] | None = None):
        self.least = least
        self.names = list(templates)
        self.words = [words_of(t) for t in templates.values()]
        named, barred = ([set(words_of((x or {}).get(name, ""))) for name in templates] for x in (named, barred))
        listed = sorted({w for ws in [*self.words, *barred] for w in ws})
        self.number = {w: i for i, w in enumerate(listed)}
        self.templates = [[self.number[w] for w in ws] for ws in self.words]
        self.named = [[{k for k, x in enumerate(ws) if x == w} for w in own] for ws, own in zip(self.words, named, strict=True)]
        self.barred = [[self.number[w] for w in own] for own in barred]
        self.need = [max(1, int(np.ceil(least * len(ws) - 1e-9))) for ws in self.words]
        self.counts = np.zeros((len(self.names), len(listed)), np.int64)
        for k, ws in enumerate(self.templates):
            np.add.at(self.counts[k], ws, 1)

    def notices(self, t: int, own: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(template, coverage, first word, last word) of each notice of one template in a text's known words.

        Windows begin at the template's words and are SLACK times its length. Those whose words (counted as often as
        the template has them) suffice are aligned from left to right; words that name the license must be paired; a notice's words are gone for the next.
        """
        words = self.templates[t]
        mine = np.flatnonzero(self.counts[t][own])
        others = places[np.isin(own, self.barred[t])]
        own, places = own[mine], places[mine]
        if len(own) < self.need[t]:
            return
        end = np.searchsorted(places, places + SLACK * len(words))
        shared = np.zeros(len(own), np.int64)
        for w in set(words):
            seen = np.concatenate([[0], np.cumsum(own == w)])
            shared += np.minimum(seen[end] - seen[:-1], self.counts[t][w])
        free = 0
        for at in np.flatnonzero(shared >= self.need[t]).tolist():
            if at < free:
                continue
            pairs = align(own[at : end[at]].tolist(), words)
            paired = {y for _, y in pairs}
            if len(pairs) >= self.need[t] and all(paired & where for where in self.named[t]):
                first, last = at + pairs[0][0], at + pairs[-1][0]
                if ((others > places[first]) & (others < places[last])).any():
                    continue
                yield t, len(pairs) / len(words), int(places[first]), int(places[last])
                free = last + 1

    def scan(self, s: T.Slice) -> list[list[tuple[int, float, int, int]]]:
        """Notices of each document, by place and template."""
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in range(len(s))]
        starts, ends, first = T.word_spans(s)
        ids, words = T.intern(s.buf, starts, ends)
        if not len(ids):
            return out
        number = np.array([self.number.get(normal(w), -1) for w in words.to_pylist()])[ids]
        at = np.flatnonzero(number >= 0)
        doc = np.searchsorted(first, at, side="right") - 1
        held = np.bincount(doc * len(self.number) + number[at], minlength=len(s) * len(self.number)).reshape(len(s), -1)
        for lo in range(0, len(s), 256):
            most = np.minimum(held[lo : lo + 256, None], self.counts[None]).sum(axis=2)  # no alignment can pair more
            for d, t in zip(*np.nonzero(most >= np.array(self.need)), strict=True):
                a, b = np.searchsorted(doc, lo + d), np.searchsorted(doc, lo + d, side="right")
                out[lo + d] += self.notices(int(t), number[at[a:b]], at[a:b] - first[lo + d])
        for found in out:
            found.sort(key=lambda x: (x[2], x[0]))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, n_notices, licenses, best_coverage, notices) for each row of ``docs``.

    ``licenses`` are the distinct names found, sorted and comma-joined; ``notices`` is an array of (name, coverage,
    first word, last word), by place. A narrow map over the scan. Null, empty and blank texts have none (best_coverage
    0); a null doc_id stays null; repeated rows each give a row; other columns are ignored.
    """
    T.bound_batches(docs.sparkSession)
    scanner = Scanner(templates, least) if templates else Scanner(TEMPLATES, least, NAMED, BARRED)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches):
            found = scanner.scan(s)
            yield pa.RecordBatch.from_arrays(
                [
                    s.ids,
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([",".join(sorted({scanner.names[t] for t, *_ in x})) for x in found]),
                    pa.array([max((c for _, c, *_ in x), default=0.0) for x in found]),
                    pa.array([[{"license": scanner.names[t], "coverage": c, "first_word": a, "last_word": b} for t, c, a, b in x] for x in found], kind),
                ],
                names=["doc_id", "n_notices", "licenses", "best_coverage", "notices"],
            )

    return T.id_text(docs).mapInArrow(run, "doc_id long, n_notices long, licenses string, best_coverage double, notices array<struct<license: string, coverage: double, first_word: long, last_word: long>>")
