"""License scans by conditional compression.

A license template that a block of text repeats makes the block nearly free
to write down: compressed with the template as a raw zstandard dictionary it
shrinks far more than alone.  Candidate blocks are runs of words around the
three-word shingles that templates have; each is compressed with every
template that has shingles there; the largest reduction wins, and the winner
is confirmed by the exact difference of its wording.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
CLAUSE = re.compile(r"(?<!\S)\d+\.(?=\s+[A-Z])")  # a clause's number: a copy may write (a), i. or none
SHINGLE = 3
BLOCK = 1 << 20

#: How notices name a license.
NOTICES = {
    "mit": "the MIT License", "isc": "the ISC License", "unlicense": "the Unlicense",
    "apache-2.0": "the Apache License, Version 2.0", "apache-2.0-short": "the Apache License 2.0",
    "bsd-2-clause": "the BSD 2-Clause License", "bsd-3-clause": "the BSD 3-Clause License",
    "gpl-2.0": "the GNU General Public License, version 2", "gpl-3.0": "the GNU General Public License, version 3",
    "lgpl-2.1": "the GNU Lesser General Public License, version 2.1", "lgpl-3.0": "the GNU Lesser General Public License, version 3",
    "agpl-3.0": "the GNU Affero General Public License, version 3", "mpl-2.0": "the Mozilla Public License, Version 2.0",
    "epl-2.0": "the Eclipse Public License, Version 2.0", "cc0-1.0": "CC0 1.0", "cc-by-4.0": "CC BY 4.0", "cc-by-sa-4.0": "CC BY-SA 4.0",
    "cc-by-nc-4.0": "CC BY-NC 4.0", "cc-by-nd-4.0": "CC BY-ND 4.0", "cc-by-nc-sa-4.0": "CC BY-NC-SA 4.0", "cc-by-nc-nd-4.0": "CC BY-NC-ND 4.0",
    "cc-by-4.0-long": "a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-long": "a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0-long": "a Creative Commons Attribution-NonCommercial 4.0 International License",
}

#: License identifiers of SPDX tags.
SPDX_TAGS = (
    "MIT", "MIT-0", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

#: The wording of public licenses, without names and years.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."),
    "gpl-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
    "bsd-2-clause": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause": _BSD_HEAD + (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission. ") + _BSD_TAIL,
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0"),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."),
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
}
TEMPLATES |= {name: TEMPLATES["gpl-3.0-or-later"].replace("GNU General", f"GNU {kind}").replace("version 3", f"version {version}")
              for name, kind, version in (("gpl-2.0-or-later", "General", "2"), ("lgpl-2.1-or-later", "Lesser General", "2.1"),
                                          ("lgpl-3.0-or-later", "Lesser General", "3"), ("agpl-3.0-or-later", "Affero General", "3"))}
TEMPLATES |= {f"{name}-notice": f"under {wording}" for name, wording in NOTICES.items()}
TEMPLATES |= {f"spdx-{tag.lower()}": f"SPDX-License-Identifier: {tag}" for tag in SPDX_TAGS}

Span = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                     T.StructField("reduction", T.DoubleType()), T.StructField("missing", T.ArrayType(T.StringType())),
                     T.StructField("extra", T.ArrayType(T.StringType()))])


@dataclass(frozen=True)
class Found:
    license: str
    start: int
    end: int
    reduction: float
    missing: list[str]
    extra: list[str]


class Scanner:
    """``differences``: of a template's words the share that may be missing or extra (one word at least if over ten).

    Numbered clauses aside, a word with a digit is a version: none may be missing.
    """

    def __init__(self, templates: dict[str, str], differences: float = 0.1):
        self.differences = differences
        self.words = {name: WORD.findall(text.lower()) for name, text in sorted(templates.items())}
        self.words = {name: w for name, w in self.words.items() if w}
        self.clauses = {}
        for name in self.words:
            begins = {m.start() for m in CLAUSE.finditer(templates[name])}
            self.clauses[name] = {i for i, m in enumerate(WORD.finditer(templates[name])) if m.start() in begins}
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.with_template = {
            name: zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
                (" ".join(w) + " ").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, w in self.words.items()}
        self.shingles: dict[tuple[str, ...], dict[str, list[int]]] = {}  # -> template -> places in it
        for name, w in self.words.items():
            n = min(SHINGLE, len(w))
            for i in range(len(w) - n + 1):
                self.shingles.setdefault(tuple(w[i:i + n]), {}).setdefault(name, []).append(i)
        self.short = {len(s) for s in self.shingles}

    def _runs(self, hits: list[tuple[int, list[int]]], length: int) -> Iterator[tuple[int, int]]:
        """Hits (place, places in the template) that may belong to one copy of a template of ``length`` words.

        A large gap, or a jump back in the template, begins another copy.
        """
        first = last = hits[0][0]
        at = hits[0][1][0]
        for h, places in hits[1:]:
            nearest = min(places, key=lambda p: abs(p - at - (h - last)))
            if h - last > length // 2 + SHINGLE or at - nearest >= max(1, length // 3):
                yield first, last
                first, nearest = h, places[0]
            last, at = h, nearest
        yield first, last

    def _confirmed(self, name: str, words: list[str], a: int, b: int) -> tuple[int, int, list[str], list[str]] | None:
        own, block = self.words[name], words[a:b]
        same = [m for m in SequenceMatcher(None, own, block, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return None
        begin, stop = same[0].b, same[-1].b + same[-1].size
        kept_own = {i for m in same for i in range(m.a, m.a + m.size)}
        kept_block = {i for m in same for i in range(m.b, m.b + m.size)}
        missing = [w for i, w in enumerate(own) if i not in kept_own]
        extra = [block[i] for i in range(begin, stop) if i not in kept_block]
        most = int(self.differences * len(own))
        versions = {i for i, w in enumerate(own) if any(c.isdigit() for c in w)} - self.clauses[name]
        if not versions <= kept_own:
            return None
        return (a + begin, a + stop, missing, extra) if len(missing) <= most and len(extra) <= most else None

    def scan_words(self, words: list[str]) -> list[tuple[str, int, int, float, list[str], list[str]]]:
        hits: dict[str, list[tuple[int, list[int]]]] = {}
        for n in self.short:
            for i, s in enumerate(zip(*(words[k:] for k in range(n)))):
                if s in self.shingles:
                    for name, places in self.shingles[s].items():
                        hits.setdefault(name, []).append((i, places))
        ranks: dict[tuple[int, int], list] = {}  # a block's templates by reduction; templates that begin alike ask for the same block
        runs = sorted((first, last, name) for name, at in hits.items() for first, last in self._runs(at, len(self.words[name])))
        out = []
        for first, last, name in runs:
            slack = 1 + int(self.differences * len(self.words[name]))  # words at the ends that no shingle holds
            a, b = max(0, first - slack), min(len(words), last + SHINGLE + slack)
            if (first, last) not in ranks:
                block = " ".join(words[first:last + SHINGLE]).encode()
                alone = len(self.plain.compress(block))
                # every template with shingles in this block competes for it
                rivals = {other for f in range(first, last + 1) for other in self.shingles.get(tuple(words[f:f + SHINGLE]), {})} | {name}
                ranks[first, last] = sorted((-(1 - len(self.with_template[r].compress(block)) / alone), -len(self.words[r]), r) for r in rivals)
            for reduction, _, winner in ranks[first, last]:
                if got := self._confirmed(winner, words, a, b):
                    if winner == name:
                        out.append((name, got[0], got[1], -reduction, got[2], got[3]))
                    break
        # of overlapping finds the one that reads more of the text stays
        out.sort(key=lambda f: (-(f[2] - f[1]), f[1], f[0]))
        kept: list[tuple] = []
        for f in out:
            if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: (f[1], f[0]))

    def scan(self, text: str | None) -> list[Found]:
        """All finds of a whole text, by place; ``start`` and ``end`` count characters."""
        if not text:
            return []
        lower = text.lower()
        words = WORD.findall(lower)
        if not any(s in self.shingles for n in self.short for s in zip(*(words[k:] for k in range(n)))):
            return []
        found = self.scan_words(words)
        if not found:
            return []
        if len(lower) != len(text):  # a few letters change their length in lower case: places are those of the words
            spans = [m.span() for m in WORD.finditer(text)]
            if len(spans) != len(words):
                spans = [m.span() for m in WORD.finditer(lower)]
        else:
            spans = [m.span() for m in WORD.finditer(lower)]
        return [Found(n, spans[a][0], spans[b - 1][1], r, m, e) for n, a, b, r, m, e in found]


def scanned(spark, text: Column, templates: dict[str, str] | None = None, differences: float = 0.1) -> Column:
    """An array column of (license, start, end, reduction, missing, extra) of every whole text; empty without finds."""
    shared = spark.sparkContext.broadcast((templates or TEMPLATES, differences))

    @F.arrow_udf(T.ArrayType(Span))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(*shared.value)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()),
                                   ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))]))
        for texts in batches:
            yield pa.array([[vars(f) for f in scanner.scan(t.as_py())] for t in texts], kind)

    return run.asNondeterministic()(text)
