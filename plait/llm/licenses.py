"""License scans by patience alignment.

A text and a license template are aligned as word sequences: words that occur once in both are anchors, the longest
increasing subsequence of anchors is kept, and the gaps between kept anchors are aligned in the same way. A gap without anchors
takes the common words at its two ends and then the longest common subsequence of the rest (by
bit-parallel rows). Coverage is the share of the template's words that are aligned.

Every text is aligned whole, from its first word to its last: it is neither cut to windows nor at gaps, so insertions of any length, words
put between the template's and parts that lie far apart do not change what is found. Words that the template lacks take no part in
an alignment and are left out before it. A template needs its share of words in the text at all, so templates whose
words the text lacks are not aligned: an upper bound that loses nothing. ``scan`` so finds a template just when ``align`` of the
whole text covers it well enough (tests hold the two together).

As alignment has no bound on gaps, a short notice may be covered by words that are scattered over a long text. Each find has its span
(the shortest end of the text that holds so many matches, from its last possible first word) and its density, the share of aligned words
in the span. The best find is the one of largest coverage times density; ``min_density`` drops finds that are more scattered.

The templates that come with the module are short license texts and the notices by which longer licenses are
applied. Whole texts of any license are read by ``templates_from`` a folder.

Defined cases. Null and blank texts have no license. Repeated rows each return their row. Very long texts
are aligned whole. Templates are a bounded parameter that is sent to all tasks. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
MIN_COVERAGE = 0.8
#: Templates larger than this in all are refused, as they are sent to every task.
MAX_TEMPLATE_BYTES = 16 << 20

# Notices by which public licenses are applied, and short license texts.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
}


def templates_from(spark: SparkSession, folder: str) -> dict[str, str]:
    """Whole license texts as templates: the ``*.txt`` files of a folder that Spark reads, by file name. Their size is checked first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    if (files.agg(F.sum("length")).first()[0] or 0) > MAX_TEMPLATE_BYTES:
        raise ValueError("the templates are too large to send to every task")
    return {r.path.rsplit("/", 1)[-1].removesuffix(".txt"): bytes(r.content).decode("utf-8", "replace") for r in files.collect()}


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tails, at, back = [], [], [-1] * len(values)
    for k, v in enumerate(values):
        p = bisect_left(tails, v)
        back[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(v)
            at.append(k)
        else:
            tails[p], at[p] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with the shorter sequence as the bits of a row."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def span(a: list[str], b: list[str], n: int) -> tuple[int, int]:
    """A run [lo, hi) of ``a`` that has ``n`` words of ``b`` in order: the first such end, and the last start for it."""

    def reach(xs: list[str], ys: list[str]) -> int:
        where: dict[str, int] = {}
        for k, w in enumerate(ys):
            where[w] = where.get(w, 0) | 1 << k
        full = row = (1 << len(ys)) - 1
        for at, w in enumerate(xs, 1):
            hit = row & where.get(w, 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
                if len(ys) - row.bit_count() >= n:
                    return at
        return len(xs)

    hi = reach(a, b)
    return hi - reach(a[:hi][::-1], b[::-1]), hi


def align(a: list[str], b: list[str]) -> int:
    """Words of the template ``b`` that patience alignment matches in the whole text ``a``."""
    mine = frozenset(b)
    a = [w for w in a if w in mine]
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            total, a0, b0 = total + 1, a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            total, a1, b1 = total + 1, a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b.get(w) == 1}
        anchors = [(place[w], k) for k, w in enumerate(b[b0:b1], b0) if w in place]
        if not anchors:
            total += common_length(a[a0:a1], b[b0:b1])
            continue
        kept = [anchors[k] for k in increasing([x for x, _ in anchors])]
        total += len(kept)
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)], strict=True):
            todo.append((x0 + 1, x1, y0 + 1, y1))
    return total


class Scanner:
    def __init__(self, templates: Mapping[str, str], min_coverage: float, min_density: float = 0.0):
        self.templates = [(name, words(t)) for name, t in sorted(templates.items())]
        self.counts = [Counter(t) for _, t in self.templates]
        self.least, self.dense = min_coverage, min_density

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, float]]:
        """(license, coverage, first word, last word + 1, density) of each template that is covered well enough."""
        ws = words(text)
        have = Counter(ws)
        out = []
        for (name, t), counts in zip(self.templates, self.counts, strict=True):
            need = self.least * len(t)
            if not t or sum(min(n, have[w]) for w, n in counts.items()) < need:
                continue
            n = align(ws, t)
            if n >= need:
                first, end = span(ws, t, n)
                if n >= self.dense * (end - first):
                    out.append((name, n / len(t), first, end, n / (end - first)))
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, min_density: float = 0.0) -> DataFrame:
    """(doc_id, license, coverage, n_licenses, found): the best template (of largest coverage times density; ties: the longer, then the name) and all found with spans of words."""
    if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError("the templates are too large to send to every task")
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates, min_coverage, min_density))
    names = ("license", "coverage", "first_word", "end_word", "density")
    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()), strict=True))))

    def run(batches):
        s = scanner.value
        lengths = {n: len(t) for n, t in s.templates}
        for b in batches:
            found = [s.scan(t.as_py()) for t in b.column(1)]
            best = [min(f, key=lambda x: (-x[1] * x[4], -lengths[x[0]], x[0]), default=(None, 0.0)) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array([[dict(zip(names, x, strict=True)) for x in f] for f in found], kind)],
                names=["doc_id", "license", "coverage", "n_licenses", "found"],
            )

    src = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, license string, coverage double, n_licenses long, found array<struct<license:string,coverage:double,first_word:long,end_word:long,density:double>>")
