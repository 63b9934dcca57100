"""Operator 10, license scans by patience alignment.

A template is found where a text's words cover it.  Windows with enough of a template's words are
aligned with it: words that occur once in the window and once in the template are anchors, the longest
increasing subsequence of anchors is kept, and the gaps between them are aligned in the same way, after
equal words at a gap's ends are matched.  Coverage is the matched share of the template's words.
The words that tell a license from others (``MUST``) have to stand in the found place, without words between them.

Every row gets a row.  Defined results: no license, coverage 0 and null places where nothing reaches the
threshold (null, empty and word-less texts among them); of several finds the best covered one is told
first, then the longer template, then the earlier place; a template that is part of a longer one gives way
to it; full texts of the GNU, Apache, Mozilla and Creative Commons licenses are not among the templates; ``licenses`` names all that stand in places not
taken by a better one; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts, utf8
from .op7_decontaminate import _SIGNS
from .shingles import words

THRESHOLD = 0.8
# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "BSD text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "ISC": "Licensed under the ISC License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
}
# the words that must stand together
MUST = {
    "Apache-2.0": ["Apache License, Version 2.0"], "Apache-2.0 header": ["Apache License, Version 2.0"], "MIT": ["MIT License"],
    "BSD-3-Clause": ["BSD 3-Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"], "ISC": ["ISC License"],
    "GPL-3.0": ["GNU General Public License, version 3"], "GPL-2.0": ["GNU General Public License, version 2"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"], "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"], "MPL-2.0": ["Mozilla Public License, v. 2.0"],
    "CC0-1.0": ["CC0 1.0"], "Unlicense": ["free and unencumbered software"],
} | {f"CC-{x}-4.0": [f"CC {x} 4.0"] for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")}
for _name, _kind, _thing, _version in (("GPL-3.0", "", "program", "3"), ("GPL-2.0", "", "program", "2"), ("AGPL-3.0", "Affero ", "program", "3"),
                                       ("LGPL-3.0", "Lesser ", "library", "3"), ("LGPL-2.1", "Lesser ", "library", "2.1")):
    TEMPLATES[f"{_name} notice"] = (
        f"This {_thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License as published by "
        f"the Free Software Foundation, either version {_version} of the License, or (at your option) any later version. This {_thing} is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")
    MUST[f"{_name} notice"] = [f"GNU {_kind}General Public License", f"version {_version} of the License"]
for _name, _kind in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                     ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    TEMPLATES[f"CC-{_name}-4.0 notice"] = f"This work is licensed under a Creative Commons {_kind} 4.0 International License."
    MUST[f"CC-{_name}-4.0 notice"] = [f"Creative Commons {_kind} 4.0 International"]
_AS_IS = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
          "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
          "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
          "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
          "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_TWO = (TEMPLATES["BSD text"] + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. ")
TEMPLATES |= {
    "BSD-2-Clause full": _TWO + _AS_IS,
    "BSD-3-Clause full": _TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                         "from this software without specific prior written permission. " + _AS_IS,
    "MIT full": TEMPLATES["MIT text"] + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
                'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
                "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
                "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
                "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
                'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
                "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
}
MUST["BSD-2-Clause full"] = ["provided with the distribution THIS SOFTWARE IS PROVIDED BY"]
MUST["BSD-3-Clause full"] = ["Neither the name of"]


def increasing(x: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of x, by patience sorting."""
    tops, piles, before = [], [], []
    for i, v in enumerate(x):
        k = bisect_left(tops, v)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of a and b, ascending."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        left, right = Counter(a[i:m]), Counter(b[j:n])
        at = {b[k]: k for k in range(j, n) if right[b[k]] == 1}
        anchors = [(k, at[a[k]]) for k in range(i, m) if left[a[k]] == 1 and a[k] in at]
        anchors = [anchors[k] for k in increasing([y for _, y in anchors])]
        if anchors:
            out += anchors
            bounds = [(i - 1, j - 1), *anchors, (m, n)]
            gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(bounds, bounds[1:]) if u > x + 1 and v > y + 1]
    return sorted(out)


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), _SIGNS)[0]


def holds(run: list[int], part: list[int]) -> bool:
    return any(run[k:k + len(part)] == part for k in range(len(run) - len(part) + 1))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold, self.template = threshold, []
        for name, text in templates.items():
            h = _words(text)
            table = np.zeros(1 << 16, bool)
            table[(h >> np.uint64(48)).astype(np.int64)] = True
            self.template.append((name, h, table, [_words(m).tolist() for m in MUST.get(name, ())]))
        runs = {name: h.tolist() for name, h, *_ in self.template}
        self.parts = {name: {n for n, r in runs.items() if len(r) < len(run) and holds(run, r)} for name, run in runs.items()}

    def scan(self, data: np.ndarray, at: np.ndarray) -> list[list[tuple]]:
        """For each text its finds (coverage, words, name, first byte, end byte), best first."""
        h, start, end, first = words(data, at, _SIGNS)
        found: list[list[tuple]] = [[] for _ in range(len(at) - 1)]
        high = (h >> np.uint64(48)).astype(np.int64)
        for name, t, table, must in self.template:
            size, reach = len(t), len(t) + len(t) // 4 + 1
            need = -(-int(self.threshold * 1000) * size // 1000)
            known = np.flatnonzero(table[high])
            known = known[np.isin(h[known], t)]
            if len(known) < need:
                continue
            # the word that is the need-th known one from here must lie within reach, in the same text
            near = known[:len(known) - need + 1]
            text = np.searchsorted(first, near, "right") - 1
            far = known[need - 1:]
            ok = (far - near < reach) & (far < first[text + 1])
            ids, done, best = t.tolist(), -1, None
            starts = list(zip(near[ok].tolist(), text[ok].tolist()))
            for k, (p, x) in enumerate(starts):
                if p < done:
                    continue
                seen = h[p:min(p + reach, int(first[x + 1]))].tolist()
                pairs = align(ids, seen)
                if len(pairs) >= self.threshold * size - 1e-9 and (best is None or len(pairs) > best[0]):
                    a, z = pairs[0][1], pairs[-1][1]
                    if all(holds(seen[a:z + 1], m) for m in must):
                        best = len(pairs), p + a, p + z
                # the windows from one find's first start to its end compete; the best covered one is told
                if best is None or k + 1 < len(starts) and starts[k + 1][1] == x and starts[k + 1][0] <= best[2]:
                    continue
                found[x].append((best[0] / size, size, name, int(start[best[1]] - at[x]), int(end[best[2]] - at[x])))
                done, best = best[2] + 1, None
        return [self._best(f) for f in found]

    def _best(self, found: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        found = [f for f in found if not any(f[2] in self.parts[g[2]] and g[3] <= f[3] and f[4] <= g[4] for g in found)]
        for f in sorted(found, key=lambda f: (-f[0], -f[1], f[3], f[2])):
            if all(f[4] <= k[3] or f[3] >= k[4] for k in kept):
                kept.append(f)
        return kept


def _scanned(templates: dict[str, str], threshold: float):
    def run(batches):
        scanner = Scanner(templates, threshold)
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                found = scanner.scan(*utf8(part.column("text")))
                top = [f[0] if f else (0.0, 0, None, None, None) for f in found]
                yield pa.record_batch([part.column("doc_id"), part.column("tag"), pa.array([f[2] for f in top], pa.string()),
                                       pa.array([f[0] for f in top], pa.float64()), pa.array([f[3] for f in top], pa.int64()),
                                       pa.array([f[4] for f in top], pa.int64()),
                                       pa.array([sorted({x[2] for x in f}) for f in found], pa.list_(pa.string()))],
                                      ["doc_id", "text_crc32", "license", "coverage", "first_byte", "end_byte", "licenses"])
    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_crc32, license, coverage, first_byte, end_byte, licenses for every row."""
    rows = texts(docs).select("doc_id", F.crc32("text").alias("tag"), "text")
    return rows.mapInArrow(_scanned(templates, threshold), "doc_id long, text_crc32 long, license string, coverage double, "
                                                           "first_byte long, end_byte long, licenses array<string>")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("licenses", F.concat_ws(",", "licenses"))
