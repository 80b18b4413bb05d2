"""License scans by patience alignment.

A text is aligned with a template: words that occur once in both are anchors, the longest increasing
subsequence of anchors is kept, and the gaps between are aligned in the same way; equal words next to an
anchor are taken along. The share of the template's words that are aligned is its coverage.

A template is tried on a text only if the words that they share could reach the coverage, which loses
nothing. First it is looked for in windows where enough of its long words stand together, so that each of
several copies is found; then what lies outside of the stretches found is aligned as a whole, so that
a copy that is spread out is found by the unique words of the whole rest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb
from .workspace import whole

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)

#: The texts of public licences, without their title and copyright lines, and usual notices.
TEMPLATES: dict[str, str] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. " + _AS_IS
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": _BSD_GRANT + _BSD_SOURCE + _BSD_BINARY + _BSD_AS_IS,
    "bsd-3-clause": _BSD_GRANT + _BSD_SOURCE + _BSD_BINARY + _BSD_NAMES + _BSD_AS_IS,
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not "
        "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
        "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS
    ),
    "boost-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered "
        'by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software "
        "and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        'machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "all-rights-reserved": "All rights reserved.",
}


def words_of(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Word hashes of a text and their byte spans."""
    block = next(tb.blocks(pa.array([text])))
    starts, ends, _ = tb.spans(block, tb.letter_bytes())
    return tb.span_hash(block.prefix(tb.byte_values(7, True)), starts, ends).tolist(), list(zip(starts.tolist(), ends.tolist(), strict=True))


def _increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = last[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            last.append(i)
        else:
            tails[k], last[k] = v, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], increasing in both, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        seen_a: dict[int, int] = {}
        for i in range(a0, a1):
            seen_a[a[i]] = -1 if a[i] in seen_a else i
        seen_b: dict[int, int] = {}
        for j in range(b0, b1):
            seen_b[b[j]] = -1 if b[j] in seen_b else j
        anchors = [(i, seen_b[w]) for w, i in seen_a.items() if i >= 0 and seen_b.get(w, -1) >= 0]
        anchors.sort()
        kept = [anchors[k] for k in _increasing([j for _, j in anchors])]
        if not kept:
            continue
        i0, j0 = a0, b0
        for i, j in [*kept, (a1, b1)]:
            if i < a1:
                out.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def _windows(where: np.ndarray, need: int, n: int, lo: int, hi: int) -> list[list[int]]:
    """Places between words lo and hi at which ``need`` of the words ``where`` stand within twice ``n``, with
    ``n`` words before and after; those that overlap are one, up to three times ``n``."""
    out: list[list[int]] = []
    end = where[need - 1 :]
    for i in np.flatnonzero(end - where[: len(end)] < 2 * n).tolist():
        a, b = max(lo, int(where[i]) - n), min(hi, int(end[i]) + n + 1)
        if out and a < out[-1][1] and b - out[-1][0] <= 3 * n:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def stretches(template: list[int], word: np.ndarray, where: np.ndarray, need: int, least: float) -> list[tuple[int, int, int]]:
    """(matched, first word, last word) of the stretches of a text that cover ``least`` of the template, none
    overlapping: first in windows around the words ``where``, then in what lies between."""
    n = len(template)
    enough = -(-least * n // 1)
    size = Counter(template)
    out: list[tuple[int, int, int]] = []

    def tried(lo: int, hi: int) -> tuple[int, int, int] | None:
        part = word[lo:hi].tolist()
        if sum((size & Counter(part)).values()) < enough:
            return None
        pairs = align(template, part)
        return (len(pairs), lo + pairs[0][1], lo + pairs[-1][1]) if len(pairs) >= enough else None

    for lo, hi in _windows(where, need, n, 0, len(word)):
        if found := tried(lo, hi):
            same = [x for x in out if x[1] <= found[2] and found[1] <= x[2]]
            if all(found[0] > x[0] for x in same):
                out = [x for x in out if x not in same] + [found]
    out.sort(key=lambda x: x[1])
    todo = list(zip([0, *(x[2] + 1 for x in out)], [*(x[1] for x in out), len(word)], strict=True))
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= enough and (found := tried(lo, hi)):
            out.append(found)
            todo += [(lo, found[1]), (found[2] + 1, hi)]
    return sorted(out, key=lambda x: x[1])


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, least: float = 0.75, long_word: int = 5) -> DataFrame:
    """Licence templates in every whole text of ``docs`` (doc_id, text).

    Returns per row doc_id and found, an array of (template, matched int, words int, coverage double,
    first_byte long, end_byte long) for each stretch with a coverage of at least ``least``, in the
    order of the text; it is empty for null, empty and other texts. Stretches of one template don't overlap:
    of several windows the one with more matched words counts. Windows are where half of a
    template's words of ``long_word`` or more bytes (of all its words, if it has none) stand within twice its
    length. Repeated rows come back as often; other columns are ignored.
    """
    known = {name: words_of(text) for name, text in (TEMPLATES if templates is None else templates).items()}
    known = {name: w for name, w in known.items() if w[0]}
    keys = {}
    for name, (hashes, spans) in known.items():
        rare = [h for h, (x, y) in zip(hashes, spans, strict=True) if y - x >= long_word]
        keys[name] = np.unique(np.array(rare or hashes, np.uint64))
    vocabulary = np.unique(np.array([h for hashes, _ in known.values() for h in hashes] or [0], np.uint64))
    is_key = {name: np.isin(vocabulary, k) for name, k in keys.items()}
    times = {name: np.bincount(np.searchsorted(vocabulary, np.array(hashes, np.uint64)), minlength=len(vocabulary)) for name, (hashes, _) in known.items()}
    kind = "array<struct<template:string,matched:int,words:int,coverage:double,first_byte:long,end_byte:long>>"
    names = ("template", "matched", "words", "coverage", "first_byte", "end_byte")
    arrow = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, values = tb.letter_bytes(), tb.byte_values(7, True)
        for batch in batches:
            for block in tb.blocks(batch.column(1)):
                starts, ends, text = tb.spans(block, inside)
                word = tb.span_hash(block.prefix(values), starts, ends)
                at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
                hits = np.flatnonzero(vocabulary[at] == word)
                # of each text the distinct words of any template
                there = np.unique(text[hits] * np.int64(len(vocabulary)) + at[hits])
                owner, which = there // len(vocabulary), there % len(vocabulary)
                bounds = np.searchsorted(text, np.arange(len(block) + 1))
                out: list[list[tuple]] = [[] for _ in range(len(block))]
                for name, (hashes, _) in known.items():
                    n = len(hashes)
                    shared = np.bincount(owner, weights=times[name][which], minlength=len(block))
                    for doc in np.flatnonzero(shared >= least * n).tolist():
                        lo, hi = int(bounds[doc]), int(bounds[doc + 1])
                        mine = hits[np.searchsorted(hits, lo) : np.searchsorted(hits, hi)]
                        where = mine[is_key[name][at[mine]]] - lo
                        for matched, a, b in stretches(hashes, word[lo:hi], where, -(-len(keys[name]) // 2), least):
                            out[doc].append((name, matched, n, matched / n, int(starts[lo + a] - block.starts[doc]), int(ends[lo + b] - block.starts[doc])))
                found = [[dict(zip(names, r, strict=True)) for r in sorted(rows, key=lambda r: (r[4], r[0]))] for rows in out]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(found, arrow)], names=["doc_id", "found"])

    return docs.select(whole(docs, "doc_id", "long").alias("doc_id"), whole(docs, "text", "string").alias("text")).mapInArrow(run, f"doc_id long, found {kind}")
