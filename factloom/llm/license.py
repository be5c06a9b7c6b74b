"""License scans: winnowed fingerprints find candidates, banded alignment measures them.

Words are runs of ASCII letters, digits and bytes from 128 on, A-Z lower-cased. Templates
are cut into 3-word fingerprints; of each 2 neighbouring ones the least is kept, so a
common run of 4 words always shares a kept fingerprint. An inverted index from fingerprint
to template and position picks candidates; hits of one template whose diagonals follow each
other within ``band`` words are a candidate region, aligned by a local alignment (match 1,
mismatch and gap -1) inside that band. A place is reported if the matched words cover
``least`` of the template. The best place of a template is taken first; what its region
holds left and right of taken places is aligned again, as long as it has hits, so a notice
that stands several times in a row is reported each time and reported places never overlap.

``TEMPLATES`` cover MIT, ISC, BSD with two and three clauses in whole and in parts, the notices
(file headers) of Apache 2.0, GPL 3, LGPL 2.1, AGPL 3, MPL 2.0 and EPL 2.0, the opening of the
Unlicense, one-line notices and Creative Commons 4.0 BY, BY-SA, BY-NC and CC0. The bodies of the
Apache, GPL, LGPL, AGPL, MPL, EPL and Creative Commons texts are not covered.

Null and empty texts match nothing; very long ones are scanned whole. Templates are looked for
each by itself: where several match one place (notices are alike), each gets a row and coverage
tells them apart; of equally good alignments the first is taken. Repeated rows, and those without
doc_id, are scanned each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .toxicity import _TOKEN

GRAM, WINNOW, BAND = 3, 2, 8

# Texts of public licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "mit-line": "Released under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-sa-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-clauses": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "lgpl2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Whole texts from their parts, so that coverage is also measured against the licence as a whole.
for _name, _parts in {
    "mit": ("mit-grant", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit-warranty"),
    "isc": ("isc-grant", "isc-warranty"),
    "bsd-2": ("bsd-grant", "bsd-clauses", "bsd-disclaimer"),
    "bsd-3": ("bsd-grant", "bsd-clauses", "bsd-3-clause", "bsd-disclaimer"),
}.items():
    TEMPLATES[f"{_name}-text"] = " ".join(TEMPLATES.get(p, p) for p in _parts)


def _hashes(data: np.ndarray, offs: np.ndarray):
    data = _TOKEN[data]
    starts, ends, first = tk.words(data, offs)
    return tk.word_hashes(data, starts, ends), first


def _kept(grams: np.ndarray) -> np.ndarray:
    """Positions of the least of each ``WINNOW`` neighbouring fingerprints."""
    if len(grams) < WINNOW:
        return np.arange(len(grams))
    w = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)
    return np.unique(w.argmin(axis=1) + np.arange(len(w)))


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = []
        entries = []
        for t, text in enumerate(templates.values()):
            raw = np.frombuffer(text.encode(), np.uint8)
            w, _ = _hashes(raw, np.array([0, len(raw)]))
            self.words.append(w)
            g = tk.window_hashes(w, GRAM)
            entries += [(int(g[p]), t, p) for p in _kept(g).tolist()]
        entries.sort()
        # A template of one fingerprint has no run of 4 words; it is looked up in all of a text's.
        self.alone = np.array([e[0] for e in entries if len(self.words[e[1]]) < GRAM + WINNOW - 1], np.uint64)
        self.prints = np.array([e[0] for e in entries], np.uint64)
        self.where = np.array([e[1:] for e in entries], np.int64).reshape(-1, 2)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, template, template position) of all kept fingerprints that are in the index."""
        kept = np.union1d(_kept(grams), np.flatnonzero(np.isin(grams, self.alone)))
        lo = np.searchsorted(self.prints, grams[kept], "left")
        n = np.searchsorted(self.prints, grams[kept], "right") - lo
        pos = np.repeat(kept, n)
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pos, self.where[entry, 0], self.where[entry, 1]


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Local alignment with |position - template position - shift| <= band: matched words, first and last-plus-one word."""
    best = (0, 0, 0, 0)
    before: dict[int, tuple[int, int, int]] = {}
    for i, t in enumerate(template.tolist()):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(words), i + shift + band + 1)):
            score, matched, start = before.get(j - 1, (0, 0, j))
            same = t == words[j]
            if score <= 0:
                score, matched, start = 0, 0, j
            cell = (score + 1, matched + 1, start) if same else (score - 1, matched, start)
            for other in (before.get(j), row.get(j - 1)):
                if other and (other[0] - 1, other[1]) > cell[:2]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] > 0:
                row[j] = cell
                if (cell[1], cell[0]) > best[:2]:
                    best = (cell[1], cell[0], cell[2], j + 1)
        before = row
    return best[0], best[2], best[3]


def _regions(diagonal: np.ndarray, size: int, band: int) -> list[tuple[int, int]]:
    """(shift, half width) of bands that hold every alignment of a template of ``size`` words near the diagonals.

    An alignment with a positive score has fewer gaps than words, so its diagonals are less than
    ``size`` apart; longer chains are cut in windows that overlap by that much.
    """
    out = []
    for g in np.split(diagonal, np.flatnonzero(np.diff(diagonal) > band) + 1):
        start = int(g[0])
        while True:
            part = g[np.searchsorted(g, start) : np.searchsorted(g, start + 2 * size, "right")]
            if len(part):
                shift = int(part[len(part) // 2])
                whole = g[-1] - g[0] <= 2 * size
                out.append((shift, band + int(part[-1] - part[0] if whole else max(part[-1] - shift, shift - part[0]))))
            if start + 2 * size >= g[-1]:
                break
            start += size
    return out


def _places(template: np.ndarray, w: np.ndarray, pos: np.ndarray, at: np.ndarray, least: float, band: int) -> list[tuple[int, int, int]]:
    """(matched, first, last plus one) of a template's places, best first taken; pos and at are its hits, by position."""
    size = len(template)
    queue: list[tuple[int, int, int, int, int]] = []
    seen: set[tuple[int, ...]] = set()

    def look(lo: int, hi: int) -> None:
        if hi - lo < max(GRAM, least * size) or (lo, hi) in seen:
            return
        seen.add((lo, hi))
        a, b = np.searchsorted(pos, (lo, hi - GRAM + 1))
        for shift, wide in _regions(np.unique(pos[a:b] - at[a:b]), size, band) if a < b else ():
            left, right = max(lo, shift - wide), min(hi, shift + size + wide)
            if (left, right, shift, wide) in seen:
                continue
            seen.add((left, right, shift, wide))
            matched, x, y = align(template, w[left:right].tolist(), shift - left, wide)
            if matched >= least * size:
                heapq.heappush(queue, (-matched, x + left, y + left, left, right))

    look(0, len(w))
    taken: list[tuple[int, int, int]] = []
    while queue:
        n, x, y, left, right = heapq.heappop(queue)
        k = bisect.bisect(taken, (x,))
        if (k == 0 or taken[k - 1][1] <= x) and (k == len(taken) or taken[k][0] >= y):
            taken.insert(k, (x, y, -n))
        # What the region holds outside taken places.
        i = max(bisect.bisect(taken, (left,)) - 1, 0)
        while i < len(taken) and taken[i][0] < right:
            if taken[i][1] > left:
                look(left, taken[i][0])
                left = taken[i][1]
            i += 1
        look(left, right)
    return [(n, x, y) for x, y, n in taken]


def scan_words(w: np.ndarray, index: Index, least: float, band: int = BAND) -> list[tuple[str, int, float, int, int]]:
    """(template, matched, coverage, first word, last word plus one) of all reported places of a text."""
    if len(w) < GRAM:
        return []
    pos, tem, at = index.hits(tk.window_hashes(w, GRAM))
    found = []
    for t in np.unique(tem).tolist():
        m = tem == t
        size = len(index.words[t])
        found += [(index.names[t], n, round(n / size, 6), a, b) for n, a, b in _places(index.words[t], w, pos[m], at[m], least, band)]
    return found


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.6) -> DataFrame:
    """doc_id, template, matched, coverage, start, end: a row for each place of a template in a document."""
    templates = TEMPLATES if templates is None else templates

    def fn(batches):
        index = Index(templates)
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, offs in tk.blocks(b.column(1)):
                w, first = _hashes(data, offs)
                g = tk.window_hashes(w, GRAM)
                # Rows that hold no fingerprint at all are passed by.
                some = np.flatnonzero(np.isin(g, index.prints))
                rows = np.unique(np.searchsorted(first, some, "right") - 1)
                out = [(ids[lo + r].as_py(), *x) for r in rows.tolist() for x in scan_words(w[first[r] : first[r + 1]], index, least)]
                cols = list(zip(*out)) if out else [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "template", "matched", "coverage", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(fn, "doc_id long, template string, matched long, coverage double, start long, end long")
