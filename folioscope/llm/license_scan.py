"""License scans: template markup compiled into token automata.

A template is license wording with two kinds of marked regions::

    [[ optional words ]]          may be absent; regions may be nested
    {{name:most}}                 replaceable: 0 to ``most`` words of any kind

Everything else is mandatory and must match word for word. Words are compared as the base
rule takes them (A-Z lower-cased, split at ASCII punctuation and white space), so line breaks,
quotes and punctuation never matter.

The automaton runs only from places where the template's first two words stand, which are
found for all templates at once by comparing word hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import small_batches
from folioscope.llm.words import LOWER, PLAIN, Words, blocks, word_hash

#: Base phrases and labels, fixed by the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [[ (the \"Software\") ]], to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_BSD_TWO = "[[ 1. ]] Redistributions of source code must retain the [[ above ]] copyright notice, this list of conditions and the following disclaimer. [[ 2. ]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY {{provider:12}} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{owner:12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Label and wording of each template. The wordings are those of the public licenses and notices; labels
#: that end in -whole stand for a license text from its first word to its last.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 [[ (the \"License\"); you may not use this file except in compliance with the License ]]"),
    ("mit-notice", "Released under the [[ terms of the ]] MIT License"),
    ("mit-notice", "Licensed under the [[ terms of the ]] MIT License"),
    ("mit-text", _MIT_GRANT),
    ("gpl-3.0", "licensed under the GNU General Public License [[ , ]] version 3 [[ or {{later:4}} later version ]]"),
    ("gpl-2.0", "licensed under the GNU General Public License [[ , ]] version 2 [[ or {{later:4}} later version ]]"),
    ("gpl-notice", "you can redistribute it and/or modify it under the terms of the GNU [[ Lesser ]] [[ Affero ]] General Public License as published by the Free Software Foundation"),
    ("bsd-text", _BSD_GRANT),
    ("isc-text", _ISC_GRANT + " [[ , provided that the above copyright notice and this permission notice appear in all copies ]]"),
    ("cc-by-nc-4.0", "Licensed under [[ a Creative Commons {{kind:6}} License ]] CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under [[ a Creative Commons {{kind:6}} License ]] CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under [[ a Creative Commons {{kind:6}} License ]] CC BY 4.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "Copyright {{holder:12}} All rights reserved"),
    ("mit-whole", _MIT_GRANT + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice [[ (including the next paragraph) ]] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{owner:12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-2-whole", f"{_BSD_GRANT}: {_BSD_TWO} {_BSD_DISCLAIMER}"),
    ("bsd-3-whole", f"{_BSD_GRANT}: {_BSD_TWO} [[ 3. ]] Neither the name of {{{{holder:12}}}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}"),
    ("isc-whole", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND {{author:8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{owner:8}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib-whole", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: [[ 1. ]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. [[ 2. ]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. [[ 3. ]] This notice may not be removed or altered from any source distribution."),
    ("unlicense-whole", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0-whole-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at {{address:8}} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-whole-notice", "you can redistribute it and/or modify it under the terms of the GNU [[ Lesser ]] [[ Affero ]] General Public License as published by the Free Software Foundation, either version {{version:2}} of the License, or (at your option) any later version. {{program:8}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU [[ Lesser ]] [[ Affero ]] General Public License for more details."),
    ("mpl-2.0-whole-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {{address:8}}"),
)


def read_templates(spark: SparkSession, folder: str) -> tuple[tuple[str, str], ...]:
    """Templates from text files: a label on the first line, the wording after it.

    For license texts too long to stand here, such as the whole GPL. The folder is a catalogue of
    licenses, not a corpus: its few files come to the driver, as TEMPLATES stand there.
    """
    files = spark.read.text(folder, wholetext=True).collect()
    return tuple(sorted((label.strip(), wording) for label, wording in (r["value"].split("\n", 1) for r in files)))


ANY = None
_PART = re.compile(r"\[\[|\]\]|\{\{\w+:(\d+)\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Automaton:
    """States 0..n; ``steps[s]`` lists (word hash or ANY, next state), ``skips[s]`` states reached without a word."""

    label: str
    lead: tuple[int, int]
    steps: tuple[tuple[tuple[int | None, int], ...], ...]
    skips: tuple[tuple[int, ...], ...]

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[int], at: int) -> int:
        """Words of the shortest accepted text that begins at ``at``; 0 if there is none."""
        final = len(self.steps) - 1
        states = self._closed({0})
        for used, word in enumerate(words[at:], 1):
            states = self._closed({to for s in states for want, to in self.steps[s] if want is ANY or want == word})
            if not states:
                return 0
            if final in states:
                return used
        return 0


def compile_template(label: str, wording: str) -> Automaton:
    """Raises ValueError for unbalanced regions or a template that doesn't begin with two mandatory words."""
    steps: list[list[tuple[int | None, int]]] = [[]]
    skips: list[list[int]] = [[]]

    def more() -> int:
        steps.append([])
        skips.append([])
        return len(steps) - 1

    opened: list[int] = []
    lead: list[int] = []
    for m in _PART.finditer(wording.translate(_ASCII_LOWER)):
        part, here = m[0], len(steps) - 1
        if part == "[[":
            if len(lead) < 2:
                raise ValueError(f"{label}: a template begins with two mandatory words")
            opened.append(here)
        elif part == "]]":
            if not opened:
                raise ValueError(f"{label}: ]] without [[")
            skips[opened.pop()].append(here)
        elif m[1]:
            if len(lead) < 2 and not (len(lead) == 1 and int(m[1])):
                raise ValueError(f"{label}: a template begins with a mandatory word")
            entry = [here]
            for _ in range(int(m[1])):
                to = more()
                steps[entry[-1]].append((ANY, to))
                entry.append(to)
            end = more()
            for s in entry:
                skips[s].append(end)
            if len(lead) == 1:
                lead.append(0)  # the second word is free: any word may follow the first
        else:
            h = word_hash(part.encode())
            to = more()
            steps[here].append((h, to))
            if len(lead) < 2:
                lead.append(h)
    if opened or len(lead) < 2:
        raise ValueError(f"{label}: unbalanced regions or too few words")
    return Automaton(label, (lead[0], lead[1]), tuple(map(tuple, steps)), tuple(map(tuple, skips)))


OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_templates", pa.int64()),
    ]
)
_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long"


def _consecutive(h: np.ndarray, doc: np.ndarray, want: list[int]) -> np.ndarray:
    """Places where the hashes ``want`` stand one after the other in one document."""
    at = np.flatnonzero(h == np.uint64(want[0]))
    for k in range(1, len(want)):
        at = at[at + k < len(h)]
        at = at[(h[at + k] == np.uint64(want[k])) & (doc[at + k] == doc[at])]
    return at


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.automata = [compile_template(*t) for t in templates]
        self.phrases = [([word_hash(w.encode()) for w in p.split()], label) for p, label in PHRASES]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list]:
        data = LOWER[data]
        w = Words(data, offsets, PLAIN)
        h, doc, first = w.hashes(data), w.doc(), w.first
        n = w.n_docs
        places: list[list[int]] = [[] for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        extra: list[set[str]] = [set() for _ in range(n)]
        matched = [0] * n
        for want, label in self.phrases:
            for at in _consecutive(h, doc, want).tolist():
                d = int(doc[at])
                places[d].append(at - int(first[d]))
                base[d].add(label)
        for a in self.automata:
            lead = [a.lead[0]] if a.lead[1] == 0 else list(a.lead)
            for at in _consecutive(h, doc, lead).tolist():
                d = int(doc[at])
                # an accepted text has at most one word for each state
                if a.accepts(h[at : min(int(first[d + 1]), at + len(a.steps))].tolist(), 0):
                    extra[d].add(a.label)
                    matched[d] += 1
        rows = []
        for d in range(n):
            p = places[d]
            rows.append(
                [
                    int(first[d + 1] - first[d]), len(p), min(p) if p else None, max(p) if p else None, ",".join(sorted(base[d])),
                    ",".join(sorted(base[d] | extra[d])), 1.0 if matched[d] else 0.5 if p else 0.0, matched[d],
                ]
            )
        return rows


def _scan_all(batches: Iterator[pa.RecordBatch], templates: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates)
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            columns = list(zip(*scanner.scan(data, offsets), strict=True))
            arrays = [batch.column(0).slice(lo, hi - lo)] + [pa.array(c, f.type) for c, f in zip(columns, list(OUT)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=OUT)


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Licenses named or quoted in each row of ``docs``.

    Base columns count the places where a phrase of PHRASES stands. ``labels`` adds those of the
    accepted templates. score: 1 with an accepted template, else 0.5 with a base phrase, else 0.

    A null or empty text has no words and no labels. Rows are scanned one by one: repeated rows
    give equal rows, an empty table an empty result. Other columns are ignored. The compiled
    automata are a constant of the program; nothing is broadcast.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(lambda it: _scan_all(it, templates), _DDL)
