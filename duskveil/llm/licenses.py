"""License scans: TF-IDF cosine of headers and licence files to templates, and inheritance from directories.

Every line of a file and every window of ``WINDOWS`` terms of it (in steps of a quarter) is compared with all templates, so
notices are found where they stand in a longer line or run over several, and licence texts wherever they begin; a file named
LICENSE, LICENCE, COPYING or UNLICENSE (in any case) is compared as a whole as well. Terms are lower-cased ASCII words and
numbers; w = tf * idf, with idf from the number of all files that hold the term. The best template with a cosine of
``LEAST`` or more is the file's licence (ties: the template named first); one that names a version needs that number. tf >= 1 bounds a stretch's norm from below by a sum
over its terms, so running sums give an upper bound of every cosine, and only stretches whose bound reaches ``LEAST`` are
scored one by one; nothing that could match is left out.

A file without a licence inherits from its nearest ancestor directory that has a licence file with one: directories are
resolved first, by joining each directory's own ancestors to the licence files, and files then join their directory, so no
file row is multiplied and no task holds all files of one directory.

Null text is an empty file. A null path is a file in the root directory. Of several licence files in one directory the
best cosine counts, then the smaller id. Repeated rows each get their row. Very long texts are scanned in stretches of
``STRETCH`` terms that overlap by the widest window. Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_ANY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NAMED = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_FREE2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; version {1} of the License."
_HEAD = "GNU {0} Version {1}, Copyright (C) {2} Free Software Foundation, Inc."
_COPIES = _HEAD + " Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
#: Texts and notices of well-known licences (fixed values).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "
        "Licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "
        "Legal Entity shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.",
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _ANY + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", _FREE.format("General Public License", 3), _HEAD.format("GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007"), _COPIES.format("GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007"), "SPDX-License-Identifier: GPL-3.0", "GNU General Public License Version 3"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", _FREE2.format("General Public License", 2), _FREE.format("General Public License", 2), _HEAD.format("GENERAL PUBLIC LICENSE", "2, June 1991", "1989, 1991"), _COPIES.format("GENERAL PUBLIC LICENSE", "2, June 1991", "1989, 1991"), "SPDX-License-Identifier: GPL-2.0", "GNU General Public License Version 2"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", _FREE.format("Lesser General Public License", 3), _HEAD.format("LESSER GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007"), _COPIES.format("LESSER GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007"), "SPDX-License-Identifier: LGPL-3.0"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", _FREE.format("Lesser General Public License", 2.1), _HEAD.format("LESSER GENERAL PUBLIC LICENSE", "2.1, February 1999", "1991, 1999"), _COPIES.format("LESSER GENERAL PUBLIC LICENSE", "2.1, February 1999", "1991, 1999"), "SPDX-License-Identifier: LGPL-2.1"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", _FREE.format("Affero General Public License", 3), _HEAD.format("AFFERO GENERAL PUBLIC LICENSE", "3, 19 November 2007", "2007"), _COPIES.format("AFFERO GENERAL PUBLIC LICENSE", "3, 19 November 2007", "2007"), "SPDX-License-Identifier: AGPL-3.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", _NAMED, f"{_BSD_GRANT} {_BSD_TWO} 3. {_NAMED} {_BSD_END}"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_END}"],
    "ISC": [
        "Licensed under the ISC License.", "ISC License", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"],
}
#: Least cosine of a match; terms of a window; terms that are scanned at a time.
LEAST, WINDOWS, STRETCH = 0.7, (6, 16, 48, 192), 1 << 15
#: Terms before a number that tells versions apart.
_VERSIONED = frozenset(b"version v apache gpl lgpl agpl bsd mpl cc0 by nc attribution noncommercial".split())
_TERM = re.compile(rb"[a-z]+|[0-9]+(?:\.[0-9]+)*|\n")


def terms_of(text: bytes) -> list[bytes]:
    return [t for t in _TERM.findall(text.lower()) if t != b"\n"]


VOCABULARY = frozenset(t for lines in TEMPLATES.values() for line in lines for t in terms_of(line.encode()))


def document_frequencies(files: DataFrame) -> tuple[dict[bytes, int], int]:
    """(files that hold each term of the templates, all files)."""
    schema = pa.schema([("term", pa.string()), ("files", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in common.text_bytes(b.column(0)):
                held[b""] += 1
                held.update(VOCABULARY & set(terms_of(t)))
        yield common.batch(schema, [k.decode() for k in held], list(held.values()))

    common.prepare(files.sparkSession)
    made = files.select(F.col("text").cast("string")).mapInArrow(work, "term string, files long")
    got = {r[0].encode(): r[1] for r in made.groupBy("term").agg(F.sum("files")).collect()}  # a row per term of the templates
    return got, got.pop(b"", 0)


class Matcher:
    """Finds the template nearest to a text by cosine of TF-IDF."""

    def __init__(self, df: dict[bytes, int], n: int):
        self.idf = {t: log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        self.other = log(n + 1) / 2 + 1  # the weight of a term that no template has
        made = [(name, terms_of(line.encode())) for name, lines in TEMPLATES.items() for line in lines]
        self.templates = [(name, self._vector(terms)) for name, terms in made]
        self.version = [next((b for a, b in zip(terms, terms[1:]) if a in _VERSIONED and b[:1].isdigit()), None) for _, terms in made]
        self.place = {t: k for k, t in enumerate(sorted(VOCABULARY))}
        self.numbers = {**self.place, b"\n": -1}
        self.square = np.array([self.idf[t] ** 2 for t in self.place] + [self.other**2])
        self.gain = np.zeros((len(self.place) + 1, len(self.templates)), np.float32)  # of a term to the product with each template
        for k, (_, w) in enumerate(self.templates):
            for t, x in w.items():
                self.gain[self.place[t], k] = x * self.idf[t]

    def _vector(self, terms: list[bytes]) -> dict[bytes, float]:
        made = {t: c * self.idf.get(t, self.other) for t, c in Counter(terms).items()}
        norm = sqrt(sum(x * x for x in made.values())) or 1.0
        return {t: x / norm for t, x in made.items()}

    def best(self, terms: list[bytes]) -> tuple[float, str | None]:
        v = self._vector(terms)
        near = ((sum(x * v.get(t, 0.0) for t, x in w.items()), -k) for k, (_, w) in enumerate(self.templates) if self.version[k] is None or self.version[k] in v)
        found = max(near, default=(0.0, 0))
        return found[0], self.templates[-found[1]][0]

    def stretches(self, n: int, lines: np.ndarray) -> np.ndarray:
        """(from, to) of the lines and windows of n terms; lines: where lines begin, among the terms."""
        cuts = np.unique(np.concatenate([[0], lines, [n]]))
        made = [np.stack([cuts[:-1], cuts[1:]], 1)]
        for w in WINDOWS:
            start = np.arange(0, max(1, n - w + w // 4), w // 4)
            made.append(np.stack([start, np.minimum(start + w, n)], 1))
        return np.unique(np.concatenate(made), axis=0)

    def licence(self, text: bytes, whole: bool) -> tuple[str | None, float, int]:
        """(licence, cosine, stretches that match) of a file."""
        found = _TERM.findall(text.lower())
        known, last = self.numbers, len(self.place)
        ids = np.fromiter([known.get(t, last) for t in found], np.int64, len(found))
        breaks = ids < 0
        lines = np.flatnonzero(breaks) - np.arange(breaks.sum())
        terms = [t for t in found if t != b"\n"]
        ids = ids[~breaks]
        best, hits, most, at = (0.0, None), 0, max(WINDOWS), 0
        while at < len(ids):
            some = ids[at : at + STRETCH]
            inside = np.flatnonzero(some < last)
            if len(inside):
                spans = self.stretches(len(some), lines[(lines > at) & (lines < at + STRETCH)] - at)
                for s, e in spans[self._likely(some, inside, spans)].tolist():
                    got = self.best(terms[at + s : at + e])
                    hits += got[0] >= LEAST
                    best = got if got[0] > best[0] else best
            if at + STRETCH >= len(ids):
                break
            at += STRETCH - most
        if whole and terms:
            got = self.best(terms)
            best = got if got[0] > best[0] else best
        return (best[1], best[0], hits) if best[0] >= LEAST else (None, 0.0, 0)

    def _likely(self, ids: np.ndarray, inside: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Which spans may reach LEAST: a product over the least norm that their terms allow bounds the cosine."""
        norm = np.sqrt(np.diff(np.concatenate([[0.0], np.cumsum(self.square[ids])])[spans], axis=1)[:, 0])
        # of each span, its terms of the vocabulary
        lo, hi = np.searchsorted(inside, spans[:, 0]), np.searchsorted(inside, spans[:, 1])
        top = self.gain.max(1)[ids[inside]]  # no template gains more from a term
        bound = np.diff(np.concatenate([[0.0], np.cumsum(top)])[np.stack([lo, hi], 1)], axis=1)[:, 0]
        some = np.flatnonzero(bound >= (LEAST - 1e-6) * norm)
        out = np.zeros(len(spans), bool)
        for k in some.tolist():
            out[k] = self.gain[ids[inside[lo[k] : hi[k]]]].sum(0).max() >= (LEAST - 1e-4) * norm[k]
        return out


def scan(files: DataFrame) -> DataFrame:
    """(id, path, own, cosine, headers, licence, via): of files(id, path, text) the licence found or inherited; via is
    ``header``, ``file``, the directory it comes from, or null."""
    df, n = document_frequencies(files)
    sent = common.prepare(files.sparkSession).sparkContext.broadcast(Matcher(df, n))
    schema = pa.schema([("id", pa.int64()), ("path", pa.string()), ("own", pa.string()), ("cosine", pa.float64()), ("headers", pa.int64()), ("whole", pa.bool_())])
    named = re.compile(r"(?:^|/)(?:UN)?(?:LICEN[SC]E|COPYING)[^/]*$", re.IGNORECASE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            paths = [p or "" for p in b.column(1).to_pylist()]
            whole = [bool(named.search(p)) for p in paths]
            made = [own.licence(t, w) for t, w in zip(common.text_bytes(b.column(2)), whole)]
            yield common.batch(schema, b.column(0), paths, [m[0] for m in made], [m[1] for m in made], [m[2] for m in made], whole)

    made = files.select(F.col("id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    made = common.stored(made.mapInArrow(work, "id long, path string, own string, cosine double, headers long, whole boolean"), "licences")
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    made = made.withColumn("dir", parent)
    given = made.where("whole and own is not null").groupBy("dir").agg(F.max_by("own", F.struct("cosine", -F.col("id"))).alias("licence"))
    given = given.select(F.col("dir").alias("up"), "licence")
    dirs = made.select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("up")).distinct()
    near = ups.join(given, "up").groupBy("dir").agg(F.max_by("licence", F.length("up")).alias("inherited"), F.max_by("up", F.length("up")).alias("up"))
    both = common.hot_join(made, near, "dir", "left")
    via = F.when(F.col("own").isNotNull(), F.when(F.col("whole"), "file").otherwise("header")).otherwise(F.col("up"))
    return both.select("id", "path", "own", "cosine", "headers", F.coalesce("own", "inherited").alias("licence"), via.alias("via"))
