"""License scans by patience alignment.

A text is screened for words that are telling of a template; where enough of
them stand close together, the words around are aligned with the template:
words unique to both sides anchor, the longest increasing subsequence of the
anchors is kept, and the gaps between are aligned in the same way. Coverage is
the share of the template's words that are matched. Where found notices
overlap, the one of higher coverage, then of more words, stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import textkit as tk

#: Wordings of public licences, and of the usual notices that name them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Words too common to tell of a template.
PLAIN = frozenset("a an and any are as at be by can do either following for form from has in is it may not of on or so that the this to under use v version whom with without work you 0 1 2 3 4".split())
MIN_COVERAGE = 0.8
#: A notice lies within so many times its template's words.
SPREAD = 2


def templates_in(folder: str) -> list[tuple[str, str]]:
    """Templates from the .txt files of a folder of the driver, named by their files: whole texts of any licence."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.txt"))]


def words_of(text: str) -> list[str]:
    data = tk.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = tk.word_bounds(data, np.array([0, len(data)]), tk.ALNUM)
    whole = data.tobytes()
    return [whole[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ascending in the first) that ascends in the second."""
    tails, at, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(tails, j)
        back.append(at[place - 1] if place else -1)
        if place == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[place], at[place] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two word sequences, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # ends of a gap that agree
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        out.extend(anchors)
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True) if k > i + 1 and m > j + 1)
    return sorted(out)


class Scanner:
    """Templates compiled for screening."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, min_coverage: float = MIN_COVERAGE):
        self.min_coverage = min_coverage
        self.templates = []
        for name, text in templates:
            words = words_of(text)
            if not words:
                continue
            hashes = self._hashes(words)
            telling = [h for h, w in zip(hashes, words, strict=True) if w not in PLAIN] or hashes
            # a match of min_coverage misses so many words at most
            missing = int(len(words) * (1 - min_coverage) + 1e-9)
            self.templates.append((name, hashes, np.unique(np.array(telling, np.uint64)), max(1, len(telling) - missing), missing))
        self.keys = np.unique(np.concatenate([t[2] for t in self.templates])) if self.templates else np.zeros(0, np.uint64)

    @staticmethod
    def _hashes(words: list[str]) -> list[int]:
        data, offsets = tk.buffer_of(pa.array(words, pa.string()))
        return tk.ranges_hash(data, offsets[:-1], offsets[1:]).tolist()

    def scan(self, column) -> tuple[list[list[tuple]], np.ndarray]:
        """For each row the found notices (name, coverage, start, end in bytes), and the row offsets in bytes."""
        data, offsets = tk.buffer_of(column)
        data = tk.LOWER[data]
        starts, ends, first = tk.word_bounds(data, offsets, tk.ALNUM)
        out: list[list[tuple]] = [[] for _ in range(len(offsets) - 1)]
        if not len(starts) or not len(self.keys):
            return out, offsets
        hashes = tk.ranges_hash(data, starts, ends)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[place] == hashes)
        row_of_hit = np.searchsorted(first, hits, "right") - 1
        for name, words, keys, needed, missing in self.templates:
            at = np.minimum(np.searchsorted(keys, hashes[hits]), len(keys) - 1)
            mine = keys[at] == hashes[hits]
            own, rows = hits[mine], row_of_hit[mine]
            if len(own) < needed:
                continue
            reach = SPREAD * len(words)
            near = np.flatnonzero((own[needed - 1 :] - own[: len(own) - needed + 1] < reach) & (rows[needed - 1 :] == rows[: len(own) - needed + 1]))
            done = -1
            for k in near.tolist():
                if own[k] <= done:
                    continue
                row = rows[k]
                # the notice starts about as far before the word as the template does
                low = max(int(first[row]), int(own[k]) - words.index(int(hashes[own[k]])) - missing - 1, done + 1)
                high = min(int(first[row + 1]), low + reach)
                pairs = patience(hashes[low:high].tolist(), words)
                if len(pairs) < self.min_coverage * len(words) - 1e-9:
                    continue
                a, b = low + pairs[0][0], low + pairs[-1][0]
                if b - a >= reach:
                    continue
                if len(pairs) == len(words) == b - a + 1:  # else a later word may start a better match, and the best of them stays
                    done = b
                out[row].append((name, len(pairs) / len(words), int(starts[a]), int(ends[b]), len(pairs)))
        for row, found in enumerate(out):
            if len(found) > 1:
                kept: list[tuple] = []
                for x in sorted(found, key=lambda f: (-f[1], -f[4], f[2], f[0])):
                    if all(x[3] <= y[2] or x[2] >= y[3] for y in kept):
                        kept.append(x)
                out[row] = sorted(kept, key=lambda f: (f[2], f[0]))
        return out, offsets


def scanned(docs: DataFrame, *, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """`docs` without the text, with the licences of each whole text.

    Adds n_licenses, licenses (distinct names, sorted, comma-joined, empty if
    none), coverage (the best, 0.0 if none) and notices (name, coverage, start,
    end in code points). Null and empty texts have none. Of equal coverages the
    wording of more words, then the earlier one, stays. Repeated rows are
    scanned alike. An empty table or no templates give no notices. Input
    columns of the added names are replaced; others may have any name.
    """
    added = T.StructType(
        [
            T.StructField("n_licenses", T.LongType()),
            T.StructField("licenses", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("notices", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    kept = [c for c in docs.columns if c != text and c not in added.names]
    schema = T.StructType([*[docs.schema[c] for c in kept], *added.fields])
    kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scanner = Scanner(templates, min_coverage)
        for batch in tk.slices(batches, text):
            column = batch.column(batch.num_columns - 1)
            found, offsets = scanner.scan(column)
            chars = tk.char_index(tk.buffer_of(column)[0]) if any(found) else None
            notices = [[{"name": n, "coverage": c, "start": int(chars[a] - chars[offsets[k]]), "end": int(chars[b] - chars[offsets[k]])} for n, c, a, b, _ in f] for k, f in enumerate(found)]
            names = [sorted({x[0] for x in f}) for f in found]
            arrays = [pa.array([len(x) for x in names], pa.int64()), pa.array([",".join(x) for x in names], pa.string()), pa.array([max((x[1] for x in f), default=0.0) for f in found], pa.float64()), pa.array(notices, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=schema.names)

    return docs.select(*[f"`{c}`" for c in kept], text).mapInArrow(run, schema)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scanned(docs)
