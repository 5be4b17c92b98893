"""License scans by patience alignment.

A template is aligned with a text by anchoring on the words that occur once in each, keeping the longest run of anchors
whose order agrees, and aligning the gaps between them in the same way; a gap without such words is aligned from its
two ends.  Coverage is the share of the template's words that are aligned with one passage of the text, and a passage may be
longer than the template by no more than what coverage may lack.
"""

from __future__ import annotations

import bisect
import collections
import functools
import pathlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from biblioflux.llm.arrow_text import bound_batches, concat, row_chunks, text_buffer, word_hashes, words

MIN_COVERAGE = 0.8

_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Notices by which works are put under common public licences, a proprietary one, and short licences whole.
NOTICES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "mit": "Released under the MIT License",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "isc-whole": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "gpl-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "bsd-notice": _BSD_OPENING,
    "bsd-2-clause": f"{_BSD_OPENING} {_BSD_CLAUSES} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_OPENING} {_BSD_CLAUSES} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "all-rights-reserved": "All rights reserved",
}
#: Identifiers that stand after an SPDX tag.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()

#: Templates that differ by a clause or a name: a row gets the one with the most words aligned beyond those that are missing.
VARIANTS = [{"bsd-2-clause", "bsd-3-clause"}, {"gpl-2.0-header", "gpl-header", "lgpl-header", "agpl-header"}, {"cc-by-4.0", "cc-by-sa-4.0"}]


@functools.cache
def default_templates() -> dict[str, str]:
    """NOTICES, SPDX tags, and the texts of ``license_texts``: each whole, and of MIT the permission and notice without the disclaimer; read on the driver only."""
    texts = {p.stem: p.read_text(encoding="utf-8") for p in sorted((pathlib.Path(__file__).parent / "license_texts").glob("*.txt"))}
    whole = {f"{name}-whole": text for name, text in texts.items()} | {"mit-text": texts["mit"].partition("\n\n")[0]}
    return NOTICES | {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX} | whole


def plain_words(text: str) -> list[str]:
    """Lower-case words without the signs around them."""
    return [w for w in (x.strip(".,;:!?()[]{}\"'<>*") for x in text.lower().split()) if w]


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    pile: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect.bisect_left(tops, v)
        back[i] = pile[p - 1] if p else -1
        if p == len(tops):
            tops.append(v)
            pile.append(i)
        else:
            tops[p], pile[p] = v, i
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Ascending pairs (i, j) of aligned words a[i] == b[j]."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        alo, ahi, blo, bhi = work.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        once_a: dict = {}
        for i in range(alo, ahi):
            once_a[a[i]] = -1 if a[i] in once_a else i
        once_b: dict = {}
        for j in range(blo, bhi):
            if once_a.get(b[j], -1) >= 0:
                once_b[b[j]] = -1 if b[j] in once_b else j
        pairs = sorted((once_a[w], j) for w, j in once_b.items() if j >= 0)
        pairs = [pairs[i] for i in longest_increasing([j for _, j in pairs])]
        i, j = alo, blo
        for x, y in pairs:
            work.append((i, x, j, y))
            i, j = x + 1, y + 1
            out.append((x, y))
        if pairs:
            work.append((i, ahi, j, bhi))
    return sorted(out)


def window_words(template: list, min_coverage: float) -> int:
    """Words of the longest passage in which a template is looked for: it may have as large a share of other words as coverage may lack."""
    return max(len(template), int(len(template) / min_coverage + 1e-9))


def bounds(template: list, text: list, size: int) -> list[tuple[int, int]]:
    """(bound, start) of every window of ``size`` words that begins with a word of the template: no alignment with it has more pairs than the words that both hold."""
    room = collections.Counter(template)
    at = [j for j, w in enumerate(text) if w in room]
    held: collections.Counter = collections.Counter()
    out, common, stop = [], 0, 0
    for j in at:
        while stop < len(at) and at[stop] < j + size:
            w = text[at[stop]]
            held[w] += 1
            common += held[w] <= room[w]
            stop += 1
        out.append((common, j))
        w = text[j]
        common -= held[w] <= room[w]
        held[w] -= 1
    return out


def coverage(template: list, text: list, min_coverage: float = MIN_COVERAGE) -> float:
    """Share of the template's words aligned with the best passage, over all windows that begin with a word of it; 0 below min_coverage.

    Windows are taken by falling bound until no bound exceeds the best alignment, so none that could be better is left out.
    """
    size, need = window_words(template, min_coverage), min_coverage * len(template) - 1e-9
    best = 0
    for bound, j in sorted(bounds(template, text, size), key=lambda x: (-x[0], x[1])):
        if bound <= best or bound < need:
            break
        best = max(best, len(align(template, text[j : j + size])))
    return best / len(template) if best >= need else 0.0


def _one_variant(found: list[tuple[str, float]], length: dict[str, int]) -> list[tuple[str, float]]:
    """Of the templates found in a row, one of each set of VARIANTS."""
    for kin in VARIANTS:
        rivals = [x for x in found if x[0] in kin]
        if len(rivals) > 1:
            best = max(rivals, key=lambda x: (2 * x[1] - 1) * length[x[0]])
            found = [x for x in found if x[0] not in kin or x is best]
    return found


def _scanner(templates: dict[str, str], min_coverage: float):
    names = sorted(templates)
    split = [plain_words(templates[n]) for n in names]
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64())]))
    strip = r"^[.,;:!?()\[\]{}\"'<>*]+|[.,;:!?()\[\]{}\"'<>*]+$"

    @arrow_udf("array<struct<license:string,coverage:double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = pa.array(sorted({w for t in split for w in t}), pa.string())
        number = {w: i for i, w in enumerate(vocabulary.to_pylist())}
        length = {name: len(t) for name, t in zip(names, split)}
        coded = [[number[w] for w in t] for t in split]
        own_words = [np.unique(t, return_counts=True) for t in coded]
        for arr in batches:
            parts = []
            for piece in row_chunks(arr):
                n = len(piece)
                data, offsets = text_buffer(pc.utf8_lower(piece.fill_null("")))
                starts, ends, rows = words(data, offsets)
                found: list[list] = [[] for _ in range(n)]
                if len(starts):
                    # each distinct word is stripped and looked up once
                    code_of, first, code = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                    raw = data.tobytes()
                    spelled = pc.replace_substring_regex(pa.array([raw[x:y].decode() for x, y in zip(starts[first].tolist(), ends[first].tolist())], pa.string()), strip, "")
                    known = pc.index_in(spelled, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                    hit = known[code]
                    at = np.flatnonzero(hit >= 0)
                    have = np.bincount(rows[at] * len(number) + hit[at], minlength=n * len(number)).reshape(n, -1).astype(np.int32)
                    row_at = np.searchsorted(rows, np.arange(n + 1))
                    blank = (pc.equal(spelled, "").to_numpy(zero_copy_only=False))[code]
                    texts: dict[int, list] = {}
                    for name, t, (w, k) in zip(names, coded, own_words):
                        # no alignment covers more than the words that both hold
                        bound = np.minimum(have[:, w], k).sum(axis=1) / len(t)
                        for i in np.flatnonzero(bound >= min_coverage - 1e-9).tolist():
                            if i not in texts:
                                own = slice(row_at[i], row_at[i + 1])
                                texts[i] = hit[own][~blank[own]].tolist()
                            if c := coverage(t, texts[i], min_coverage):
                                found[i].append((name, c))
                found = [_one_variant(f, length) for f in found]
                flat = [x for f in found for x in f]
                values = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.float64())], fields=list(kind.value_type))
                offs = np.zeros(n + 1, np.int32)
                np.cumsum([len(f) for f in found], out=offs[1:])
                parts.append(pa.ListArray.from_arrays(pa.array(offs), values))
            yield concat(parts, kind)

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage): for each row of docs, the templates that a passage of it covers by ``min_coverage`` or more.

    Templates are ``default_templates()`` unless given.  A passage is a window of at most 1 / min_coverage times the
    template's words, so words in between count against a match as missing ones do.  Words are compared without case and the
    signs around them.  Rows without a match, null and empty texts among them, have no result; rows that repeat, repeat; null
    doc_ids are kept, of whatever type.  Texts are scanned whole, and a template is reported once for a row, with its best
    coverage, however often it occurs (of equal passages any stands for it); of VARIANTS the one that fits best is reported,
    the first by name of equals.  An empty table gives no rows.  Columns other than doc_id and text, those named like the
    results among them, are not looked at.  Templates without words are not looked for.
    """
    templates = {k: v for k, v in (templates or default_templates()).items() if plain_words(v)}
    return bound_batches(docs.select("doc_id", "text")).select("doc_id", F.inline(_scanner(templates, min_coverage)("text")))
