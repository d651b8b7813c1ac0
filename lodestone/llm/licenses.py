"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

Templates are few and each window is looked up, so documents are only read once and nothing is shuffled. Templates
share windows by size classes: a window is made of blocks of a stride that is a power of two, enough of them that each
run of a template's length lies whole in one. Minima of longer blocks come from those of shorter ones, two by two. A
template of m shingles whose window holds 80 % of it has a similarity of at least 0.8 m / (0.2 m + 2 m) > 0.36 to it;
of BANDS single minima all differ with a probability under 0.64 ** 22 = 6e-5. Bands and minima of a class stand in one
sorted table that windows are looked up in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import chunks, mix, words_of

SHINGLE = 5
BANDS = 22
THRESHOLD = 0.8
#: A table of templates goes to every task; it may have so many bytes of text.
TEMPLATE_BYTES = 20_000_000
#: Letters, digits and longer code points make words here, so that punctuation doesn't hide a notice.
SEPARATORS = np.ones(256, bool)
SEPARATORS[48:58] = SEPARATORS[65:91] = SEPARATORS[97:123] = SEPARATORS[128:] = False
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
    "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
#: Notices and short texts of well-known licenses, by name. Longer texts come as a table, see from_table().
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "full/MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "full/ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "full/BSD-2-Clause": f"{_CONDITIONS} 1. {_SOURCE} 2. {_BINARY} {_BSD_DISCLAIMER}",
    "full/BSD-3-Clause": f"{_CONDITIONS} 1. {_SOURCE} 2. {_BINARY} 3. {_NAMES} {_BSD_DISCLAIMER}",
    "full/Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "full/Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    + _AS_IS + " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "full/Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "full/GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "reserved": "All rights reserved",
}
_U = np.uint64
_A = np.random.default_rng(9).integers(1, 2**64, BANDS, dtype=_U) | _U(1)


@dataclass
class Template:
    name: str
    k: int  # words of a shingle: fewer than SHINGLE where the template has fewer
    shingles: np.ndarray
    size: int  # shingles of its class

    @property
    def stride(self) -> int:
        """The largest power of two that leaves three or four strides to the class."""
        return 1 << max(0, (self.size - 1).bit_length() - 2)

    @property
    def blocks(self) -> int:
        return -(-(self.size - 1) // self.stride) + 1

    @property
    def window(self) -> int:
        return self.blocks * self.stride


def _class(n: int) -> int:
    """1, 2, 4, 6, 8, 12, 16, 24, ...: the least that is no smaller."""
    if n <= 2:
        return n
    whole = 1 << (n - 1).bit_length()
    return whole if n > whole * 3 // 4 or whole == 4 else whole * 3 // 4


def prepare(templates: dict[str, str]) -> list[Template]:
    """Templates without a word are left out."""
    out = []
    for name, text in sorted(templates.items()):
        w = words_of(pa.array([text]), fold=True, separators=SEPARATORS)
        if n := len(w.hashes):
            shingles = np.unique(w.grams(k := min(SHINGLE, n)))
            out.append(Template(name, k, shingles, _class(len(shingles))))
    return out


def from_table(texts: DataFrame) -> dict[str, str]:
    """Templates of a small table (name, text), which is checked to be one: at most TEMPLATE_BYTES of text. Null names and texts are left out; of several texts of a name the first by order counts."""
    texts = texts.filter("name IS NOT NULL AND text IS NOT NULL").groupBy("name").agg(F.min("text").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates have {size} bytes; {TEMPLATE_BYTES} may go to every task")
    return {r.name: r.text for r in texts.collect()}


def _minimum(grams: np.ndarray, band: int) -> np.ndarray:
    """The band's hash of each shingle, 32 bits."""
    return ((grams * _A[band]) >> _U(32)).astype(np.uint32)


@dataclass
class Bands:
    """The table of one size class: (band, minimum) of its templates, sorted; and which upper halves of minima occur in a band."""

    members: list[Template]
    keys: np.ndarray
    owners: np.ndarray
    halves: np.ndarray

    @classmethod
    def of(cls, members: list[Template]) -> Bands:
        minima = np.array([[_minimum(t.shingles, band).min() for band in range(BANDS)] for t in members], np.uint32)
        keys = (minima.astype(_U) | (np.arange(BANDS, dtype=_U) << _U(32))).ravel()
        halves = np.zeros((BANDS, 2**16), bool)
        halves[np.tile(np.arange(BANDS), len(members)), (minima >> 16).ravel()] = True
        order = np.argsort(keys, kind="stable")
        return cls(members, keys[order], np.repeat(np.arange(len(members)), BANDS)[order], halves)

    def hits(self, band: int, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, templates) whose minima of this band agree."""
        likely = np.flatnonzero(self.halves[band][minima >> 16])
        asked = minima[likely].astype(_U) | _U(band << 32)
        low, high = np.searchsorted(self.keys, asked), np.searchsorted(self.keys, asked, "right")
        n = high - low
        return np.repeat(likely, n), self.owners[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def classes(templates: list[Template]) -> list[Bands]:
    """The tables of all size classes."""
    return [Bands.of([t for t in templates if (t.k, t.size) == key]) for key in sorted({(t.k, t.size) for t in templates})]


def find(column: pa.Array, templates: list[Bands], threshold: float = THRESHOLD) -> list[tuple[int, str, int, int, float]]:
    """(text, template, first word, words, containment) of every match; of overlapping places of one template the one that holds most of it, then the first."""
    words = words_of(column, fold=True, separators=SEPARATORS)
    found = []
    for k in sorted({b.members[0].k for b in templates}):
        group = [b for b in templates if b.members[0].k == k]
        grams = words.grams(k)
        n = np.maximum(np.diff(words.first) - k + 1, 0)  # shingles of each text
        if not n.any():
            continue
        # Each text begins at a multiple of the longest stride and is followed by blocks that hold nothing, so no window sees the next.
        longest = max(b.members[0].stride for b in group)
        room = (-(-n // longest) + max(b.members[0].blocks for b in group) - 1) * longest
        begin = np.cumsum(room) - room
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        source, place = np.repeat(words.first[:-1], n) + within, np.repeat(begin, n) + within
        grams = grams[source]
        hits: list[set[tuple[int, int]]] = [set() for _ in group]
        for band in range(BANDS):
            level, stride = np.full(room.sum(), ~np.uint32(0)), 1
            level[place] = _minimum(grams, band)
            while stride <= longest:
                for bands, own in zip(group, hits, strict=True):
                    if bands.members[0].stride == stride:
                        least = level.copy()
                        for step in range(1, bands.members[0].blocks):
                            np.minimum(least[:-step], level[step:], out=least[:-step])
                        own.update(zip(*(x.tolist() for x in bands.hits(band, least)), strict=True))
                level, stride = np.minimum(level[0::2], level[1::2]) if stride < longest else level, stride * 2
        first = np.cumsum(n) - n
        for bands, own in zip(group, hits, strict=True):
            for i, g in own:
                t = bands.members[g]
                text = int(np.searchsorted(begin, i * t.stride, "right")) - 1
                while not n[text]:  # texts without shingles share a place with the next
                    text -= 1
                at = i * t.stride - begin[text]
                window = grams[first[text] + at : first[text] + min(at + t.window, n[text])]
                inside = np.flatnonzero(np.isin(window, t.shingles))
                contained = len(np.unique(window[inside])) / len(t.shingles)
                if contained >= threshold:
                    found.append((text, t.name, -contained, int(at + inside[0]), int(inside[-1] - inside[0] + k)))
    out, taken = [], {}
    for i, name, less, first, size in sorted(found):
        places = taken.setdefault((i, name), [])
        if all(first >= b or first + size <= a for a, b in places):
            places.append((first, first + size))
            out.append((i, name, first, size, -less))
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs (text, others) with __matches: array of (license, first_word, n_words, containment), ordered by license and place.

    Null and empty texts match nothing; every row stays, with its columns; repeated rows get the same matches.
    """
    prepared = classes(prepare(templates))
    named = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    at, names = named.columns.index("__text"), [*docs.columns, "__matches"]
    kind = pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                found: list[list[dict]] = [[] for _ in range(len(part))]
                for i, name, first, n, c in find(part.column(at), prepared, threshold):
                    found[i].append({"license": name, "first_word": first, "n_words": n, "containment": c})
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if i != at), pa.array(found, pa.list_(kind))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return named.mapInArrow(run, f"{schema}, __matches array<struct<license: string, first_word: int, n_words: int, containment: double>>")
