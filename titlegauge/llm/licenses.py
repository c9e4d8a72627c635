"""Licence scans: normalised passages against licence templates by Dice coefficient over word bigrams.

Passages of a text are its lines, its paragraphs (lines between blank ones, and lines between ones
without a word, as in comment headers) and the whole text. Words
are runs without white space and ASCII punctuation, A-Z in lower case; bigrams are two words in a row.
A passage matches a template when
2 * |common| / (|passage| + |template|) >= ``THRESHOLD`` over their sets of bigrams.

The coefficient can reach t only if the larger set is at most (2 - t) / t times the smaller one, so a
passage meets only templates within those sizes. Of these, the ones that share a bigram are found
through an inverted index of the templates' bigrams, and the common ones are counted exactly.

Windows find what lies inside a passage: of all runs of words that begin and end with a bigram of a
template, those of the best coefficient that do not overlap (``TemplateIndex.windows``), where no
passage that overlaps fits as well. A match inside that of a longer template of another licence is part
of that one and not reported (a BSD-2-Clause paragraph of a BSD-3-Clause text).

The templates are fixed, so the index that every task gets has a fixed size; texts are read once,
and nothing is shuffled.

Cases: null or empty text has no match; very long texts are one step; repeated rows give repeated
results; of equal coefficients the first template by name wins a passage; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlegauge.llm.common import id_and_text, map_steps, record_batch
from titlegauge.llm.textwords import (
    WHITE_SPACE,
    WHITE_SPACE_OR_PUNCTUATION,
    byte_class,
    distinct,
    find_words,
    shingle_starts,
    shingles,
)

THRESHOLD = 0.8
#: Templates of fewer bigrams must be whole in a window: without one of them the name may be missing.
LEAST_PART = 4
LINE_BREAK = byte_class(b"\n")

# Notices that name a licence, and the whole texts of MIT, BSD-2-Clause, BSD-3-Clause and
# ISC. The bodies of the Apache, GNU, Mozilla, Creative Commons and Unlicense texts are not covered.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the 3-Clause BSD License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "Licensed under the GNU Lesser General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Licensed under the GNU Affero General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
}


@dataclass
class Passages:
    """Byte ranges in the buffer of a batch, with their rows and their words' range."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def passages(column: pa.Array) -> Passages:
    """Lines with a word, paragraphs of several such lines, and whole texts of several paragraphs."""
    lines = find_words(column, LINE_BREAK)
    solid = np.append(0, np.cumsum(~WHITE_SPACE[lines.text]))
    full = solid[lines.end] > solid[lines.start]
    # A paragraph goes on over one line break; a blank line between two lines ends it.
    row, start, end = lines.row[full], lines.start[full], lines.end[full]
    apart = np.ones(len(row), bool)
    apart[1:] = (row[1:] != row[:-1]) | (start[1:] - end[:-1] > 1)
    other_row = np.ones(len(row), bool)
    other_row[1:] = row[1:] != row[:-1]
    levels = [(row, start, end)]
    for edge in (apart, other_row):
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(row))[: len(first)] - 1
        levels.append((row[first], start[first], end[last]))
    # Paragraphs once more, where lines of punctuation alone end them too.
    worded = np.append(0, np.cumsum(~WHITE_SPACE_OR_PUNCTUATION[lines.text]))
    some = worded[lines.end] > worded[lines.start]
    row, start, end = lines.row[some], lines.start[some], lines.end[some]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] - end[:-1] > 1)][: len(row)])
    last = np.append(first[1:], len(row))[: len(first)] - 1
    levels.append((row[first], start[first], end[last]))
    row, start, end = (np.concatenate(parts) for parts in zip(*levels, strict=True))
    # A paragraph of one line and a text of one paragraph are the same passage.
    _, once = np.unique(start * (len(lines.text) + 1) + end, return_index=True)
    return Passages(row[once], start[once], end[once])


class TemplateIndex:
    """Bigram sets of the templates, and which templates hold each bigram."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        named = sorted((name, text) for name, texts in templates.items() for text in texts)
        self.names = [name for name, _ in named]
        found = find_words(pa.array([text for _, text in named], pa.string()), WHITE_SPACE_OR_PUNCTUATION)
        row, hashes = distinct(*shingles(found.row, found.first, found.hashes(), 2))
        self.sizes = np.bincount(row, minlength=len(named))
        order = np.argsort(hashes, kind="stable")
        self.keys, self.holders = hashes[order], row[order]
        self.least = np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9)
        self.most = np.floor(self.sizes * (2 - threshold) / threshold + 1e-9)

    def matches(self, column: pa.Array) -> tuple[Passages, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(passages, numbers of the matching ones, templates, coefficients, the batch's bytes)."""
        words = find_words(column, WHITE_SPACE_OR_PUNCTUATION)
        found = passages(column)
        first = np.searchsorted(words.start, found.start)
        after = np.searchsorted(words.start, found.end)
        word_hash = words.hashes()
        rows, hashes = shingles(words.row, words.first, word_hash, 2, short=False)
        place = np.flatnonzero(words.row[:-1] == words.row[1:]) if len(words.row) > 1 else rows
        # Bigrams in a template, by the place of their first word.
        low = np.searchsorted(self.keys, hashes)
        known = (low < len(self.keys)) & (self.keys[np.minimum(low, len(self.keys) - 1)] == hashes)
        where = place[known]
        begin, end = np.searchsorted(where, first), np.searchsorted(where, np.maximum(after - 1, first))
        numbers, templates, scores = [], [], []
        largest = self.most.max()
        # Known bigrams, repeats included, are at least the common ones: |common| >= t / 2 * (sum of sizes).
        enough = np.ceil(self.threshold / 2 * (self.least + self.sizes).min() - 1e-9)
        for i in np.flatnonzero(end - begin >= max(1, enough)):
            own = np.unique(hashes[np.searchsorted(place, first[i]) : np.searchsorted(place, after[i] - 1)])
            if len(own) > largest:
                continue
            at = np.searchsorted(own, self.keys)
            at[at == len(own)] = 0
            common = np.bincount(self.holders[own[at] == self.keys], minlength=len(self.names))
            fits = (len(own) >= self.least) & (len(own) <= self.most) & (common > 0)
            dice = np.where(fits, 2 * common / (len(own) + self.sizes), 0)
            best = int(dice.argmax())
            if dice[best] >= self.threshold:
                numbers.append(i)
                templates.append(best)
                scores.append(float(dice[best]))
        return found, np.array(numbers, np.int64), np.array(templates, np.int64), np.array(scores), words.text


    def windows(self, column: pa.Array) -> Matches:
        """The best windows of each row that do not overlap."""
        words = find_words(column, WHITE_SPACE_OR_PUNCTUATION)
        _, hashes = shingles(words.row, words.first, words.hashes(), 2, short=False)
        place = shingle_starts(words.row, 2)
        low, high = np.searchsorted(self.keys, hashes), np.searchsorted(self.keys, hashes, side="right")
        held = high - low
        at = np.repeat(np.arange(len(hashes)), held)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(held) - held, held)
        template = self.holders[low[at] + inner]
        # A window within reach of a template holds at least ``least`` of its bigrams.
        least = np.where(self.sizes < LEAST_PART, self.sizes, self.least)
        pair = words.row[place][at].astype(np.int64) * len(self.names) + template
        order = np.lexsort((at, pair))
        pair, at = pair[order], at[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        after = np.append(first[1:], len(pair))[: len(first)]
        rows: dict[int, list] = {}
        for a, b in zip(first, after, strict=True):
            row, name = divmod(int(pair[a]), len(self.names))
            if self.sizes[name] and b - a >= least[name] and len(np.unique(hashes[at[a:b]])) >= least[name]:
                rows.setdefault(row, []).append((name, at[a:b]))
        bounds = np.searchsorted(words.row[place], np.arange(len(column) + 1))
        out: list[tuple] = []
        for row, found in rows.items():
            begin, end = bounds[row], bounds[row + 1]
            names = hashes[begin:end]
            before, behind = _neighbours(names)
            best = [c for name, hits in found for c in self._best_ends(name, hits - begin, before, behind, int(least[name]))]
            taken: list[tuple[int, int]] = []
            # The best coefficient, then the longer template, then by place.
            for dice, name, a, b in sorted(best, key=lambda c: (-c[0], -self.sizes[c[1]], c[2], c[1])):
                i = bisect(taken, (a, b))
                # A bigram is two words, so windows of neighbouring bigrams share one.
                if (i and taken[i - 1][1] >= a - 1) or (i < len(taken) and taken[i][0] <= b + 1):
                    continue
                taken.insert(i, (a, b))
                out.append((row, words.start[place[begin + a]], words.end[place[begin + b] + 1], name, dice))
        return Matches.of(out)

    def _best_ends(self, name: int, hits: np.ndarray, before: np.ndarray, behind: np.ndarray, least: int):
        """(dice, template, first bigram, last bigram): the best window from each bigram of the template.

        A window that holds its first bigram again is no better without it, so it ends before that.
        """
        size, most = int(self.sizes[name]), int(self.most[name])
        own = np.zeros(len(before), bool)
        own[hits] = True
        for i in range(len(hits) - least + 1):
            start = int(hits[i])
            limit = int(behind[start])
            if hits[i + least - 1] >= limit:
                continue
            reach = 4 * most
            while True:
                stop = min(limit, start + reach)
                new = before[start:stop] < start
                distinct_ones = np.cumsum(new)
                if stop == limit or distinct_ones[-1] > most:
                    break
                reach *= 2
            common = np.cumsum(new & own[start:stop])
            fits = (distinct_ones <= most) & (common >= least)
            dice = np.where(fits, 2 * common / (distinct_ones + size), 0)
            best = int(dice.argmax())
            if dice[best] >= self.threshold:
                yield float(dice[best]), name, start, start + best


def _neighbours(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each name occurs last before its place (-1: nowhere), and next (the length: nowhere)."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    before, behind = np.full(len(names), -1, np.int64), np.full(len(names), len(names), np.int64)
    before[order[1:][same]] = order[:-1][same]
    behind[order[:-1][same]] = order[1:][same]
    return before, behind


@dataclass
class Matches:
    """Rows, byte ranges in the buffer, templates and coefficients."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    template: np.ndarray
    dice: np.ndarray

    @classmethod
    def of(cls, found: list[tuple]) -> Matches:
        parts = zip(*found, strict=True) if found else [[]] * 5
        return cls(*(np.array(x, t) for x, t in zip(parts, [np.int64] * 4 + [np.float64], strict=True)))


def all_matches(index: TemplateIndex, column: pa.Array) -> tuple[Matches, np.ndarray]:
    """Matching passages, and windows that fit better than every passage they overlap, by row and place."""
    found, number, template, score, text = index.matches(column)
    kept = list(zip(found.row[number], found.start[number], found.end[number], template, score, strict=True))
    of_row: dict[int, list] = {}
    for m in kept:
        of_row.setdefault(int(m[0]), []).append(m)
    more = index.windows(column)
    for w in zip(more.row, more.start, more.end, more.template, more.dice, strict=True):
        if not any(m[1] < w[2] and w[1] < m[2] and m[4] >= w[4] for m in of_row.get(int(w[0]), [])):
            kept.append(w)
    return Matches.of(sorted(_not_inside(index, kept), key=lambda m: m[:3])), text


def _not_inside(index: TemplateIndex, found: list[tuple]) -> list[tuple]:
    """``found`` without matches inside that of a longer template of another licence."""
    out: list[tuple] = []
    open_row: tuple[int, list[tuple]] = (-1, [])
    # Outer before inner; only matches that reach past the place can hold the next one.
    for m in sorted(found, key=lambda m: (m[0], m[1], -m[2], -index.sizes[m[3]])):
        around = [o for o in open_row[1] if o[2] > m[1]] if open_row[0] == m[0] else []
        if not any(
            o[2] >= m[2] and index.sizes[o[3]] > index.sizes[m[3]] and index.names[o[3]] != index.names[m[3]] for o in around
        ):
            out.append(m)
        open_row = (m[0], [*around, m])
    return out


def find_licenses(
    docs: DataFrame,
    templates: dict[str, list[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, matches: license, dice, start, end (code points, end exclusive), by start, then end."""
    docs = id_and_text(docs, id_col, text_col)
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates, threshold))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, text = all_matches(index.value, batch.column("text"))
        points = np.append(0, np.cumsum((text & 0xC0) != 0x80))
        row, start, end, template, score = found.row, found.start, found.end, found.template, found.dice
        lines = find_words(batch.column("text"), LINE_BREAK)
        begin = points[lines.bounds[row]]
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        structs = pa.StructArray.from_arrays(
            [
                pa.array([index.value.names[t] for t in template], pa.string()), pa.array(score, pa.float64()),
                pa.array((points[start] - begin).astype(np.int32)), pa.array((points[end] - begin).astype(np.int32)),
            ],
            names=["license", "dice", "start", "end"],
        )
        return record_batch(
            doc_id=batch.column("doc_id"), matches=pa.ListArray.from_arrays(pa.array(cut, pa.int32()), structs)
        )

    return map_steps(docs, step, "doc_id long, matches array<struct<license:string,dice:double,start:int,end:int>>")


def _better(a: Column, b: Column) -> Column:
    return F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).otherwise(a["start"] - b["start"])


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches, license and dice of the best match, and all matches as text."""
    found = find_licenses(docs)
    # The best match: the highest coefficient, then the first by place.
    best = F.array_sort("matches", _better)
    joined = F.concat_ws(
        ",", F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"]))
    )
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), F.get(best, F.lit(0)).alias("best"), joined.alias("matches")
    ).select("doc_id", "n_matches", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"), "matches")
