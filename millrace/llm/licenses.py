"""License scans by patience alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import named

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_NO_ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."

#: Notices, headers and passages of common licenses: id and text.
TEMPLATES: dict[str, str] = {
    "mit-line": "Released under the MIT License.",
    "mit-licensed-line": "Licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-spdx": "SPDX-License-Identifier: GPL-3.0",
    "gpl-2.0-spdx": "SPDX-License-Identifier: GPL-2.0",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-4.0-long-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-long-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-long-line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "bsd-3-clause-line": "Released under the 3-Clause BSD License.",
    "bsd-2-clause-line": "Released under the 2-Clause BSD License.",
    "bsd-style-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-2.0-line": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "lgpl-2.1-line": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": _BSD_HEAD,
    "bsd-disclaimer": _BSD_TAIL,
    "bsd-no-endorsement": _NO_ENDORSEMENT,
    "gpl": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {_NO_WARRANTY}",
    "gpl-2.0": f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. {_NO_WARRANTY}",
    "agpl-3.0": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {_NO_WARRANTY}",
    "lgpl-2.1": f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. {_NO_WARRANTY.replace('program', 'library')}",
}

#: Columns behind the key.
COLUMNS = [("license", T.StringType()), ("coverage", T.DoubleType()), *((c, T.IntegerType()) for c in ("matched_words", "template_words", "first_word", "last_word"))]
_TOKEN = re.compile(r"\w+(?:\.\w+)*")


def words_of(text: str) -> list[str]:
    """Lower-cased words; inner full stops stay, so "2.0" is one word."""
    return _TOKEN.findall(text.lower())


def patience(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], both increasing: equal ends, then words unique to both sides on their longest
    increasing subsequence, then the gaps in the same way."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        ca, cb = Counter(a[i0:i1]), Counter(b[j0:j1])
        where = {w: j for j, w in enumerate(b[j0:j1], j0) if cb[w] == 1}
        both = [(i, where[w]) for i, w in enumerate(a[i0:i1], i0) if ca[w] == 1 and w in where]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(both):
            k = bisect_left(tails, j)
            back.append(ends[k - 1] if k else -1)
            if k == len(tails):
                tails.append(j)
                ends.append(n)
            else:
                tails[k], ends[k] = j, n
        chain = []
        n = ends[-1] if ends else -1
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        chain.reverse()
        if not chain:
            continue
        out += chain
        edges = [(i0 - 1, j0 - 1), *chain, (i1, j1)]
        stack += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    """Templates made ready: which words prove that a text can't reach the coverage, and where to align."""

    def __init__(self, templates: dict[str, str], min_coverage: float) -> None:
        if not 0 < min_coverage <= 1:
            raise ValueError("min_coverage must lie in (0, 1]")
        self.min_coverage = min_coverage
        self.templates = {k: w for k, t in sorted(templates.items()) if (w := words_of(t))}
        self.signal: dict[str, set[str]] = {}
        self.counts = {k: Counter(t) for k, t in self.templates.items()}
        self.masks = {k: {w: sum(1 << j for j, x in enumerate(t) if x == w) for w in self.counts[k]} for k, t in self.templates.items()}
        self.usual = usual = Counter(w for t in self.templates.values() for w in set(t))
        for name, t in self.templates.items():
            # of these words at least one is matched wherever the coverage is reached: all others are too few
            lost, taken, chosen = len(t) - self.need(t), 0, set()
            counts = self.counts[name]
            for w in sorted(counts, key=lambda w: (-len(w), usual[w], w)):
                if taken > lost:
                    break
                chosen.add(w)
                taken += counts[w]
            self.signal[name] = chosen
        every = sorted({w for s in self.signal.values() for w in s}, key=lambda w: (-len(w), w))
        self.pattern = "(?i)" + "|".join(re.escape(w) for w in every) if every else "[^\\s\\S]"

    def need(self, t: list[str]) -> int:
        n = len(t) * self.min_coverage
        return int(n) + (n > int(n) + 1e-9)

    def scan(self, text: str) -> list[tuple[str, float, int, int, int, int]]:
        """Matches that don't overlap, the best first chosen: (license, coverage, matched, words, first, last)."""
        words = [(i, w) for i, w in enumerate(words_of(text)) if w in self.usual]
        there = Counter(w for _, w in words)
        found = []
        for name, t in self.templates.items():
            if not any(w in there for w in self.signal[name]):
                continue
            counts = self.counts[name]
            if sum(min(c, there[w]) for w, c in counts.items()) < self.need(t):
                continue
            own = [x for x in words if x[1] in counts]
            for pairs in self.aligned([w for _, w in own], name):
                found.append((len(pairs) / len(t), len(pairs), name, own[pairs[0][0]][0], own[pairs[-1][0]][0], len(t)))
        found.sort(key=lambda x: (-x[1] * x[0], -x[0], x[2], x[3], x[4]))
        kept: list = []  # by first word, so only the neighbours of a match can overlap it
        for x in found:
            i = bisect_left(kept, x[3], key=lambda y: y[3])
            if (not i or kept[i - 1][4] < x[3]) and (i == len(kept) or x[4] < kept[i][3]):
                kept.insert(i, x)
        return [(x[2], x[0], x[1], x[5], x[3], x[4]) for x in kept]

    def aligned(self, words: list[str], name: str) -> list[list[tuple[int, int]]]:
        """Alignments of ``need`` words and more in ``words``, which are the text's words that the template has (no other
        can be in an alignment). A region is searched by its least windows from left to right and, where none of them
        aligns, aligned as a whole. What lies left and right of a match is a region again."""
        t, out, regions = self.templates[name], [], [(0, len(words))]
        need = self.need(t)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        while regions:
            a, z = regions.pop()
            if z - a < need:
                continue
            hit = self._windowed(words, a, z, name, places)
            if not hit and self.common(name, words[a:z]) >= need:
                hit = [(a + i, j) for i, j in patience(words[a:z], t)]
            if len(hit) >= need:
                out.append(hit)
                regions += [(a, hit[0][0]), (hit[-1][0] + 1, z)]
        return out

    def common(self, name: str, words: Sequence[str]) -> int:
        """Length of the longest common subsequence with the template, which no alignment exceeds: bits of one number are
        the template's words."""
        masks, n = self.masks[name], len(self.templates[name])
        full = (1 << n) - 1
        v = full
        for w in words:
            u = v & masks[w]
            v = ((v + u) | (v - u)) & full
        return n - v.bit_count()

    def _windowed(self, words: list[str], a: int, z: int, name: str, places: dict[str, list[int]]) -> list[tuple[int, int]]:
        """The first match among the least windows of a region: those that hold ``need`` of the template's words, each counted as
        often as the template has it, while no window inside them does. Every alignment of ``need`` words spans one of them.
        Around a window words that it lacks may lie up to a template's length away; where a longest common subsequence of all that
        falls short there is no match. Few least windows lie over one word (their first words are no surplus), so the work
        is linear in the text."""
        t, counts = self.templates[name], self.counts[name]
        need, have, got, lo = self.need(t), Counter(), 0, a
        for hi in range(a, z):
            w = words[hi]
            have[w] += 1
            got += have[w] <= counts[w]
            if got < need:
                continue
            while got >= need:
                have[words[lo]] -= 1
                got -= have[words[lo]] < counts[words[lo]]
                lo += 1
            around = (max(a, lo - 1 - len(t)), min(z, hi + 1 + len(t)))
            if self.common(name, words[slice(*around)]) >= need:
                best = self._grown(words, (lo - 1, hi + 1), around, name, places)
                if len(best) >= need:
                    return best
        return []

    def _grown(self, words: list[str], window: tuple[int, int], around: tuple[int, int], name: str, places: dict[str, list[int]]) -> list[tuple[int, int]]:
        """The longest alignment of a window (of equals that of the smallest), of the part that aligned grown to the right over each word
        that it lacks, and of that grown to the left. A match isn't grown where no more than half of the words that it would span
        in addition align: they are of another notice."""
        t, counts = self.templates[name], self.counts[name]
        need, span = self.need(t), lambda pairs: pairs[-1][0] - pairs[0][0]
        align = lambda a, z: [(a + i, j) for i, j in patience(words[a:z], t)]
        best = align(*window)
        for right in (True, False):
            if not best:
                break
            i, j = best[0][0], best[-1][0]
            have = Counter(words[i : j + 1])
            spots = []
            for w, c in counts.items():
                at, lack = places.get(w, []), c - have[w]
                if lack > 0:
                    k = bisect_left(at, j + 1 if right else i)
                    spots += at[k : k + lack] if right else at[max(0, k - lack) : k]
            for s in sorted((s for s in spots if around[0] <= s < around[1]), reverse=not right):
                wider = align(i, s + 1) if right else align(s, j + 1)
                gain, added = len(wider) - len(best), span(wider) - span(best)
                if gain > 0 and (len(best) < need or 2 * gain > added):
                    best = wider
        return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, min_coverage: float = 0.85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each license notice in a text: license, coverage (share of the template's words that align), word span.

    A document is passed over only where a proof exists: a template of n words can lose n - need of them, so any set of
    its words that occur more often than that in it must be met in the text. One linear regular expression looks for
    these words in whole Arrow batches; the rest are aligned whole (see ``Scanner.aligned``), however many words of other texts lie between
    a notice's. ``matched_words`` over the span from ``first_word`` to ``last_word`` tells how dense a match is. No shuffle,
    and nothing but the templates is sent to the tasks.

    Defined cases: null and empty texts have no rows; the key keeps its type and a null key is kept as null. A notice that
    occurs twice has two rows. Of overlapping matches the one with more matched words times coverage stays, ties go to the higher
    coverage, then to the license's name, then to the first in the text. Repeated rows give repeated results. Very long texts
    are read whole. Other columns are ignored. An empty table gives an empty table.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, min_coverage)

    names, kinds = zip(*COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column(1), scanner.pattern), False))
            rows = [(i, *m) for i, t in enumerate(b.column(1).to_pylist()) for m in scanner.scan(t)]
            found = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 4))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(found[0]), *found[1:]], names=["doc_id", *names])

    d = named(docs, doc_id=key, text=text).withColumn("text", F.col("text").cast("string"))
    return d.mapInArrow(run, T.StructType([d.schema["doc_id"], *(T.StructField(n, k) for n, k in zip(names, kinds))]))
