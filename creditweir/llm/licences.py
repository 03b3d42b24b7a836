"""Operator 6: licence texts by the Dice coefficient over word bigrams.

Every line, every paragraph (between blank lines) and every whole text is a unit, and
so is every run of words as long as a template, wherever it starts (a window): licences
of several paragraphs, or inside a sentence, are found in longer texts. A unit's
normalised words (lower case, letters and digits) give a set of bigrams, compared
with each template's: twice the common ones over the sum of both sizes. Only units with
a bigram of a template are looked at, and only templates whose size lets the coefficient
reach the threshold (a unit's size bounds it from both sides). A window is compared
only if enough of its bigrams are the template's. Of windows that overlap the nearest
counts, the first of equals; where a line, paragraph or text with the licence has words
of the window, that unit stands for it. A window's number is its first word's.

The full texts of ``FULL`` are the public ones, in ``licence_texts``. The full AGPL and
the legal codes of Creative Commons but CC0 are not there; a full AGPL text is near
enough to be named gpl-3.0.

Null and empty texts and units of one word have no bigram and match nothing, so they
give no rows. Repeated rows match each for itself. Other columns are not read.
"""

from collections import Counter
from pkgutil import get_data

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.llm.decontamination import plain_words
from creditweir.llm.words import slices, texts_of

PERCENT = 80
# Public licence notices in their usual wording.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit-licensed-line": "Licensed under the MIT License.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
        "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to "
        "be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please "
        "refer to <http://unlicense.org/>"
    ),
}
TEMPLATES["isc"] = TEMPLATES["isc-grant"] + (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES["bsd-2-clause"] = _BSD_TERMS + _BSD_DISCLAIMER
TEMPLATES["bsd-3-clause"] = _BSD_TERMS + _BSD_NAMES + _BSD_DISCLAIMER
for _name, _word in (("lgpl-3.0-notice", "Lesser"), ("agpl-3.0-notice", "Affero")):
    TEMPLATES[_name] = TEMPLATES["gpl-3.0-notice"].replace("GNU General", f"GNU {_word} General")
FULL = ("apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0", "cc0-1.0")
TEMPLATES |= {name: get_data(__package__, f"licence_texts/{name}.txt").decode() for name in FULL}
RESULT = "doc_id long, unit string, unit_no long, licence string, n_common long, n_unit long, n_template long"


class _Templates:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        words = plain_words(pa.array(list(templates.values()), pa.string()))
        self.words = words.vocabulary
        pairs = [self._pairs(words.codes[a:b]) for a, b in zip(words.starts, words.starts[1:])]
        self.sizes = np.array([len(p) for p in pairs], np.int64)
        self.bigrams = np.unique(np.concatenate(pairs))
        self.holds = np.array([np.isin(self.bigrams, p) for p in pairs])
        self.lengths = np.diff(words.starts)  # words

    def _pairs(self, codes):
        return np.unique(codes[:-1].astype(np.int64) * len(self.words) + codes[1:])


def _units(texts: list[str]):
    """(kind, text number, unit number, unit) of a batch."""
    for i, text in enumerate(texts):
        yield "text", i, 0, text
        lines = text.split("\n")
        for k, line in enumerate(lines):
            yield "line", i, k, line
        number = 0
        kept: list[str] = []
        for line in [*lines, ""]:
            if line.strip(" \t\r\x0b\x0c"):
                kept.append(line)
            elif kept:
                yield "paragraph", i, number, "\n".join(kept)
                number, kept = number + 1, []


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row per unit of (doc_id, text) and template that it matches."""

    def run(batches):
        known = _Templates(templates)
        width = len(known.words)
        for batch in batches:
            for part in slices(batch, "text"):
                yield _match(part, known, width, percent)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, RESULT)


def _windows(words, pair: np.ndarray, known: _Templates, percent: int, covered: dict):
    """(text, template, first word, common, size) of the windows that match, the nearest of those that overlap."""
    codes, starts = words.codes.astype(np.int64), words.starts
    place = np.searchsorted(known.bigrams, pair).clip(max=max(0, len(known.bigrams) - 1))
    known_pair = known.bigrams[place] == pair if len(known.bigrams) else np.zeros(len(pair), bool)
    at = np.flatnonzero(known_pair)
    for t, length in enumerate(known.lengths.tolist()):
        if length < 2 or len(codes) < length:
            continue
        mark = np.zeros(len(pair), bool)
        mark[at] = known.holds[t][place[at]]
        totals = np.concatenate([[0], np.cumsum(mark)])
        held = totals[length - 1 :] - totals[: len(codes) - length + 1]  # of the window that starts at each word
        # No window has fewer bigrams than those in common, so this many must be the template's.
        begins = np.flatnonzero(held * (200 - percent) >= percent * known.sizes[t])
        text = np.searchsorted(starts, begins, side="right") - 1
        inside = begins + length <= starts[text + 1]
        begins, text = begins[inside], text[inside]
        if not len(begins):
            continue
        breaks = np.flatnonzero((np.diff(begins) > 1) | (np.diff(text) > 0)) + 1
        matches: dict[int, list] = {}
        for run, owner in zip(np.split(begins, breaks), text[np.concatenate([[0], breaks])].tolist()):
            first, last = int(run[0]), int(run[-1])
            own = (codes[first : last + length - 1] * len(words.vocabulary) + codes[first + 1 : last + length]).tolist()
            good = mark[first : last + length - 1].tolist()
            inner = Counter(own[: length - 1])
            common = len({p for p, g in zip(own[: length - 1], good) if g})
            for k in range(last - first + 1):
                if k:
                    old, new = own[k - 1], own[k + length - 2]
                    inner[old] -= 1
                    if not inner[old]:
                        del inner[old]
                        common -= good[k - 1]
                    inner[new] += 1
                    common += inner[new] == 1 and good[k + length - 2]
                if 200 * common >= percent * (len(inner) + known.sizes[t]):
                    matches.setdefault(owner, []).append((first + k - int(starts[owner]), int(common), len(inner)))
        for owner, of_text in matches.items():
            best: list[tuple[int, int, int]] = []
            free = np.ones(int(starts[owner + 1] - starts[owner]), bool)
            for a, b in covered.get((owner, t), []):
                free[a:b] = False
            for start, common, size in sorted(of_text, key=lambda m: (-m[1] / (m[2] + int(known.sizes[t])), m[0])):
                if free[start] and free[start + length - 1] and free[start : start + length].all():
                    free[start : start + length] = False
                    best.append((start, common, size))
            for start, common, size in sorted(best):
                yield owner, t, start, common, size


def _match(part, known: _Templates, width: int, percent: int) -> pa.RecordBatch:
    texts = texts_of(part, "text")
    words = plain_words(texts)
    numbers = pc.index_in(words.vocabulary, known.words).fill_null(-1).to_numpy().astype(np.int64)[words.codes]
    pairs = np.where((numbers[:-1] >= 0) & (numbers[1:] >= 0), numbers[:-1] * width + numbers[1:], -1)
    hit = np.flatnonzero(np.isin(pairs, known.bigrams))
    # Texts without a template's bigram hold no matching unit or window.
    chosen = np.unique(np.searchsorted(words.starts, hit, side="right") - 1)
    units = list(_units(texts.take(pa.array(chosen, pa.int64())).to_pylist()))
    doc_ids = part.column("doc_id").take(pa.array(chosen, pa.int64())).to_pylist()
    rows = []
    covered: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (text, template): words that units stand for
    if units:
        own = plain_words(pa.array([u[3] for u in units], pa.string()))
        numbers = pc.index_in(own.vocabulary, known.words).fill_null(-1).to_numpy().astype(np.int64)[own.codes]
        pair = np.where((numbers[:-1] >= 0) & (numbers[1:] >= 0), numbers[:-1] * width + numbers[1:], -1)
        found = np.isin(pair, known.bigrams)
        hits = np.concatenate([[0], np.cumsum(found)])
        place = dict.fromkeys(("text", "line", "paragraph"), (-1, 0))
        for (kind, i, number, _), a, b in zip(units, own.starts.tolist(), own.starts[1:].tolist()):
            # Lines follow each other word by word, and so do paragraphs.
            first = place[kind][1] if place[kind][0] == i else 0
            place[kind] = (i, first + b - a)
            if b - a < 2 or hits[b - 1] == hits[a]:
                continue
            mine = np.searchsorted(known.bigrams, np.unique(pair[a : b - 1][found[a : b - 1]]))
            # 2 x the smaller size over the sum is the most that can be reached.
            if not (200 * np.minimum(len(mine), known.sizes) >= percent * (len(mine) + known.sizes)).any():
                continue
            codes = own.codes[a:b].astype(np.int64)
            size = len(np.unique(codes[:-1] * len(own.vocabulary) + codes[1:]))
            able = 200 * np.minimum(len(mine), known.sizes) >= percent * (size + known.sizes)
            if not able.any():
                continue
            common = known.holds[:, mine].sum(axis=1)
            for t in np.flatnonzero(able & (200 * common >= percent * (size + known.sizes)) & (known.sizes > 0)):
                rows.append((doc_ids[i], kind, number, known.names[t], int(common[t]), size, int(known.sizes[t])))
                covered.setdefault((int(chosen[i]), int(t)), []).append((first, first + b - a))
    all_ids = part.column("doc_id")
    for text, t, start, common, size in _windows(words, pairs, known, percent, covered):
        rows.append((all_ids[text].as_py(), "window", start, known.names[t], common, size, int(known.sizes[t])))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    names = [f.split()[0] for f in RESULT.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)
