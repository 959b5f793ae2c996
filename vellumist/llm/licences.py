"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

The units of a text are its lines, its paragraphs (lines up to an empty one), the whole, and runs of neighbouring lines, across empty ones too. A run's
first and last line must each add a template's bigram of their own: without such a line the run would score no less. A run is reported if no shorter
or longer unit that overlaps it matches the same licence as well or better. A unit is normalised (lower
case, words only, copyright lines and years left out) and becomes its set of word bigrams. With a units' set A, a template's B and
the threshold t, Dice = 2 |A and B| / (|A| + |B|) can reach t only if t/(2-t) |A| <= |B| <= (2-t)/t |A|: a template outside these bounds
is never compared. An index from bigram to templates counts the rest in one go. A one-word template or unit counts its word as its bigram.

Defined cases: a null, empty or wordless text matches nothing (licence null, dice 0); ties go to the larger template, then the
smaller name; repeated rows are scanned each; other columns are ignored; an empty table gives an empty result. Whole texts are scanned,
and a line of any length is one unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

THRESHOLD = 0.85

#: Public licence texts and the usual notices that name a licence.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "MIT notice, licensed": "Licensed under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "reserved": "All rights reserved.",
}

WORD = re.compile(r"[^\W_]+")
COPYRIGHT = re.compile(r"^\W*(?:copyright|©|\(c\))\W.*\d{4}.*$", re.I)


def bigrams(text: str, most: float = float("inf")) -> frozenset[tuple[str, ...]]:
    """The set of word bigrams; a text with more than ``most`` is read only as far as it takes to know."""
    own: set[tuple[str, ...]] = set()
    last = None
    for m in WORD.finditer(text.lower()):
        word = m[0]
        if last is not None:
            own.add((last, word))
            if len(own) > most:
                return frozenset(own)
        last = word
    return frozenset(own or ([(last,)] if last is not None else []))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = sorted(templates)
        sets = [bigrams(templates[n]) for n in self.names]
        self.sizes = [len(s) for s in sets]
        self.index: dict[tuple[str, ...], list[int]] = {}
        for i, s in enumerate(sets):
            for b in s:
                self.index.setdefault(b, []).append(i)
        low = threshold / (2 - threshold)
        self.least, self.most = min(self.sizes, default=0) * low, max(self.sizes, default=0) / low
        self.low = low
        # At Dice t a unit holds at most 2 |B| (1 - t) / t bigrams that B has not.
        self.spare = 2 * max(self.sizes, default=0) * (1 - threshold) / threshold + 1e-9

    def best(self, unit: str) -> tuple[float, int, str] | None:
        """Dice, template size and name of the best template that reaches the threshold."""
        return self.score(bigrams(unit, self.most))

    def score(self, own: set | frozenset) -> tuple[float, int, str] | None:
        if not self.least <= len(own) <= self.most:
            return None
        common: dict[int, int] = {}
        index = self.index
        for b in own:
            for i in index.get(b, ()):
                common[i] = common.get(i, 0) + 1
        found = [
            (2 * n / (len(own) + self.sizes[i]), self.sizes[i], self.names[i])
            for i, n in common.items()
            if self.low * len(own) <= self.sizes[i] <= len(own) / self.low and 2 * n >= self.threshold * (len(own) + self.sizes[i])
        ]
        return min(found, key=lambda x: (-x[0], -x[1], x[2]), default=None)

    def runs(self, lines: list[tuple[int, int, str]]) -> list[tuple[float, int, str, int, int]]:
        """Matches of runs of two or more lines that have words."""
        words: list[str] = []
        first_word, spans = [], []
        for a, b, line in lines:
            if (found := WORD.findall(line.lower())) and not COPYRIGHT.match(line):
                first_word.append(len(words))
                spans.append((a, b))
                words += found
        first_word.append(len(words))
        pairs = list(zip(words, words[1:]))
        known = self.index.keys()
        out = []
        for i in range(len(spans) - 1):
            # Pairs that start in the line; the last one reaches into the next line.
            at, upto = first_word[i], first_word[i + 1]
            needed = known & set(pairs[at:upto])
            own = set(pairs[at : upto - 1])
            hits = len(own & known)
            for j in range(i + 1, len(spans)):
                if not needed or len(own) - hits > self.spare or len(own) > self.most:
                    break
                more = set(pairs[first_word[j] - 1 : first_word[j + 1] - 1]) - own
                fresh = len(more & known)
                own |= more
                hits += fresh
                needed.difference_update(pairs[first_word[j] - (j > i + 1) : first_word[j + 1] - 1])
                if needed and fresh and hits >= self.low * len(own) - 1e-9 and (m := self.score(own)):
                    out.append((*m, spans[i][0], spans[j][1]))
        return out

    def scan(self, text: str | None) -> list[tuple[float, int, str, int, int]]:
        """Matches of a text: Dice, template size, name and the unit's start and end."""
        if not text:
            return []
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append((at, at + len(line), line))
            at += len(line) + 1
        units = {(a, b) for a, b, line in lines if line.strip()}
        start = None
        paragraphs = []
        for a, b, line in [*lines, (0, 0, "")]:
            if line.strip():
                start = a if start is None else start
                end = b
            elif start is not None:
                paragraphs.append((start, end))
                start = None
        # A paragraph or text with a copyright line is compared without it.
        whole = [(a, b) for a, b in dict.fromkeys([*paragraphs, (0, len(text))]) if (a, b) not in units]
        found = []
        for a, b in sorted(units):
            if m := self.best(text[a:b]):
                found.append((*m, a, b))
        for a, b in whole:
            unit = text[a:b]
            unit = "\n".join(x for x in unit.split("\n") if not COPYRIGHT.match(x))
            if m := self.best(unit):
                found.append((*m, a, b))
        taken: dict[str, list[tuple[float, int, int]]] = {}
        for d, _, name, a, b in found:
            taken.setdefault(name, []).append((d, a, b))
        for d, size, name, a, b in sorted(self.runs(lines), key=lambda x: (-x[0], x[4] - x[3], x[3])):
            rivals = taken.setdefault(name, [])
            if not any(e >= d and s < b and a < t for e, s, t in rivals):
                rivals.append((d, a, b))
                found.append((d, size, name, a, b))
        return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, licence (best template or null), dice, n_matches, matches (name:start:end, by start, then end; code points)."""
    chosen = TEMPLATES if templates is None else templates
    fields = [
        docs.schema[id_col], T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType()),
        T.StructField("n_matches", T.LongType()), T.StructField("matches", T.StringType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, threshold)
        for batch in batches:
            best, dice, count, listed = [], [], [], []
            for text in batch.column(1):
                found = scanner.scan(text.as_py())
                top = min(found, key=lambda x: (-x[0], -x[1], x[2]), default=None)
                best.append(top[2] if top else None)
                dice.append(top[0] if top else 0.0)
                count.append(len(found))
                listed.append(",".join(f"{n}:{a}:{b}" for _, _, n, a, b in sorted(found, key=lambda x: (x[3], x[4]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(dice, pa.float64()), pa.array(count, pa.int64()), pa.array(listed, pa.string())], names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
