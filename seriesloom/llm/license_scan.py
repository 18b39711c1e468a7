"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Lines, paragraphs, whole texts and windows of a template's length, laid so that a key word
stands where the template has it, are compared with licence templates by the cosine of their
TF-IDF vectors. Document frequencies are counted over all files for the templates' words and
for the other words of all segments that could reach the threshold were these words in every
file. A segment can only reach the threshold if it has one of few key words of a template (what
is left of the template without them is too short), so all others are passed over without loss.
Words of a licence's name that a template has must be in the segment too: other versions differ in them.

A file that states no licence takes that of the nearest directory above it whose licence file
states one: directories are joined with their ancestors, and files with their directory.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage

THRESHOLD = 0.75
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([-._][^/]*)?$"
# Public licence statements by SPDX name (the last is no licence of that list).
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software),"
    " to deal in the Software without restriction"
)
_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,"
    " THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS"
    " BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE"
    " GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT"
    " LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = (
    _BSD + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution."
)
_BSD_3 = (
    _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
    " software without specific prior written permission."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
    " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)


def _gnu(kind: str, version: str, dated: str, program: str = "This program") -> tuple[str, ...]:
    """Statements of a GNU licence."""
    return (
        f"This work is licensed under the GNU {kind}General Public License, version {version}.",
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License"
        f" as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"GNU {kind}General Public License Version {version}, {dated}",
    )


def _creative_commons(short: str, words: str) -> tuple[str, ...]:
    """Statements of a Creative Commons licence."""
    return (
        f"Licensed under CC {short} 4.0.",
        f"This work is licensed under a Creative Commons {words} 4.0 International License.",
        f"SPDX-License-Identifier: CC-{short}-4.0",
    )


TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        _APACHE,
        _APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions"
        " and limitations under the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "MIT License",
        "The MIT License (MIT)",
        _MIT,
        _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,"
        " and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission"
        " notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS"
        " OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
        " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,"
        " OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (*_gnu("", "3", "29 June 2007"), "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-2.0": (*_gnu("", "2", "June 1991"), "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL-3.0": (*_gnu("Lesser ", "3", "29 June 2007", "This library"), "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-only"),
    "LGPL-2.1": (*_gnu("Lesser ", "2.1", "February 1999", "This library"), "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-only"),
    "AGPL-3.0": (*_gnu("Affero ", "3", "19 November 2007"), "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only"),
    "CC-BY-NC-4.0": _creative_commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-4.0": _creative_commons("BY", "Attribution"),
    "CC-BY-SA-4.0": _creative_commons("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _creative_commons("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative_commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _creative_commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "BSD-2-Clause": (_BSD_2, _BSD_2 + _WARRANTY, "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (_BSD, _BSD_3, _BSD_3 + _WARRANTY, "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "ISC": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"
        " copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "all-rights-reserved": ("All rights reserved.",),
}
#: A statement of this name only counts if no other is found: it stands beside licences too.
WEAK = "all-rights-reserved"
#: Size of the filter for the words whose frequencies are asked for, as a power of two.
FILTER_BITS = 23
#: Templates with fewer words are titles, and looked for as lines or paragraphs only.
LEAST_WINDOW = 3
_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Templates:
    """Unit TF-IDF vectors of the templates and the key words that a similar segment must share."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], idf: dict[str, float], unseen: float, threshold: float):
        self.idf, self.unseen, self.threshold = idf, unseen, threshold
        self.names, self.index = [], {}
        self.lengths, self.required = [], []
        self.places: dict[str, set[tuple[int, int]]] = {}  # of key words: offset in a template, its length
        keys = set()
        for name, statements in templates.items():
            for statement in statements:
                parts = words(statement)
                weights = self.weights(parts)
                norm = math.sqrt(sum(w * w for w in weights.values()))
                for w, x in weights.items():
                    self.index.setdefault(w, []).append((len(self.names), x / norm))
                self.names.append(name)
                self.lengths.append(len(parts))
                self.required.append(frozenset(words(name)).intersection(weights))
                rest = 1.0  # the squared length that is left without the heaviest words
                for w, x in sorted(weights.items(), key=lambda i: (-i[1], i[0])):
                    keys.add(w)
                    if len(parts) >= LEAST_WINDOW:
                        self.places.setdefault(w, set()).update((i, len(parts)) for i, p in enumerate(parts) if p == w)
                    rest -= (x / norm) ** 2
                    if rest < threshold**2 * 0.999:
                        break
        self.keys = keys

    def weights(self, found: list[str]) -> dict[str, float]:
        return {w: (1 + math.log(n)) * self.idf.get(w, self.unseen) for w, n in Counter(found).items()}

    def scores(self, found: list[str]) -> list[tuple[float, int]]:
        """The cosine to each template that shares a word and whose name's words are there, with its number."""
        weights = self.weights(found)
        sums: Counter = Counter()
        for w, x in weights.items():
            for k, y in self.index.get(w, ()):
                sums[k] += x * y
        norm = math.sqrt(sum(x * x for x in weights.values()))
        return [(s / norm, k) for k, s in sums.items() if self.required[k] <= weights.keys()]

    def score(self, found: list[str]) -> tuple[float, str | None]:
        """The cosine to the nearest template and its name; ties to the last name."""
        return max(((s, self.names[k]) for s, k in self.scores(found)), default=(0.0, None))

    def segments(self, text: str | None) -> Iterator[list[str]]:
        """The lines, paragraphs (lines up to a blank one) and windows with a key word, and the whole text if it has one."""
        lines = [words(line) for line in (text or "").split("\n")]
        hits = [i for i, found in enumerate(lines) if not self.keys.isdisjoint(found)]
        if not hits:
            return
        every = [w for found in lines for w in found]
        spans = {(0, len(every))}
        starts = [0]
        for found in lines:
            starts.append(starts[-1] + len(found))
        after = -1
        for i in hits:
            spans.add((starts[i], starts[i + 1]))
            if i > after:
                first, after = i, i
                while first and lines[first - 1]:
                    first -= 1
                while after + 1 < len(lines) and lines[after + 1]:
                    after += 1
                spans.add((starts[first], starts[after + 1]))
            for at in range(starts[i], starts[i + 1]):
                for offset, length in self.places.get(every[at], ()):
                    spans.add((max(0, at - offset), min(len(every), at - offset + length)))
        for a, b in sorted(spans):
            yield every[a:b]

    def hopeful(self, text: str | None) -> dict[str, tuple]:
        """By digest, the different segments that reach the threshold where words outside the templates weigh ``unseen``.

        Of each: the squared length of its words in the templates, (number, product) of the templates
        that it can reach, and (word, count) of its other words.
        """
        out: dict[str, tuple] = {}
        for found in self.segments(text):
            near = [(s, k) for s, k in self.scores(found) if s >= self.threshold - 1e-9]
            if near:
                name = blake2b(" ".join(found).encode(), digest_size=16).hexdigest()
                weights = self.weights(found)
                norm = math.sqrt(sum(x * x for x in weights.values()))
                own = sum(x * x for w, x in weights.items() if w in self.index)
                out[name] = (own, [(k, s * norm) for s, k in near], [(w, n) for w, n in Counter(found).items() if w not in self.index])
        return out


def document_frequencies(files: DataFrame, text: str, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """In how many files each word of a (small) vocabulary stands, and the number of files."""
    vocabulary = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            for t in batch.column(0):
                counts.update(vocabulary.intersection(words(t.as_py() or "")))
                n += 1
        counts[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "files"])

    sums = files.select(F.col(text).cast("string")).mapInArrow(count, "word string, files bigint").groupBy("word").agg(F.sum("files").alias("files")).collect()
    found = {r["word"]: r["files"] for r in sums}
    return found, found.pop("", 0)


def frequencies_of(files: DataFrame, text: str, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``word, files``: in how many files each ``word`` of a table stands.

    The table is not sent to the tasks: a filter of ``2 ** bits`` bits is, whatever the number
    of words; a word that passes it by chance is dropped by the join.
    """
    mask = (1 << bits) - 1
    at = (F.crc32("word").bitwiseAND(F.lit(mask)) + 1).alias("at")
    parts = wanted.select(at).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    passing = bytearray(max(1, (mask + 1) // 8))
    for r in parts:
        start = (r["part"] - 1) * len(r["bits"])
        passing[start : start + len(r["bits"])] = r["bits"][: len(passing) - start]
    passing = bytes(passing)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "files"])
            counts.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                for w in set(words(t.as_py() or "")):
                    k = zlib.crc32(w.encode()) & mask
                    if passing[k >> 3] >> (k & 7) & 1:
                        counts[w] += 1
                if len(counts) > 100_000:
                    yield counted()
        yield counted()

    if not parts:
        return wanted.select("word", F.lit(0).cast("bigint").alias("files"))
    sums = files.select(F.col(text).cast("string")).mapInArrow(count, "word string, files bigint").groupBy("word").agg(F.sum("files").alias("files"))
    return wanted.join(sums, "word")


def best_of_segments(segments: DataFrame, frequencies: DataFrame, files: int, known: Templates) -> DataFrame:
    """``digest, best``: the nearest template of each segment that reaches the threshold.

    A long template that is met nearly counts more than a short one that it contains: the
    order is by cosine times the logarithm of the template's length. ``WEAK`` comes last.
    """
    weight = (1 + F.log("o.n")) * (F.log((files + 1) / (F.col("files") + 1)) + 1)
    rest = segments.select("digest", F.explode("others").alias("o")).withColumn("word", F.col("o.word")).join(frequencies, "word")
    rest = rest.groupBy("digest").agg(F.sum(weight * weight).alias("rest"))
    cosine = F.col("d.dot") / F.sqrt(F.col("own") + F.coalesce("rest", F.lit(0.0)))
    pairs = segments.join(rest, "digest", "left").select("digest", "own", "rest", F.explode("dots").alias("d")).select("digest", F.col("d.k").alias("k"), cosine.alias("score"))
    name = F.element_at(F.array(*map(F.lit, known.names)), F.col("k") + 1)
    long = F.element_at(F.array(*(F.lit(math.log1p(n)) for n in known.lengths)), F.col("k") + 1)
    order = F.struct((name != WEAK).alias("strong"), (F.col("score") * long).alias("weight"), name.alias("license"), F.col("score").alias("score"))
    return pairs.filter(F.col("score") >= known.threshold).groupBy("digest").agg(F.max(order).alias("best"))


def ancestors(path: str) -> Column:
    """The directories of a path, from its own up to the root, which is the empty one."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan_licenses(
    files: DataFrame, path: str = "path", text: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, licence_file: str = LICENCE_FILE
) -> DataFrame:
    """``files`` without ``text``, with ``license, score, origin, directory``.

    ``origin`` is ``stated`` if the file itself states the licence (``score`` is the cosine),
    ``inherited`` if it comes from the licence file in ``directory``, and null if there is
    none. Texts of any length are read whole. Of several licence files of a directory the best score counts, ties by name. Null
    paths have no directory and inherit nothing; null and empty texts state nothing. Repeated
    rows stay rows, columns of those names are replaced, an empty table gives no rows.
    """
    vocabulary = {w for statements in templates.values() for s in statements for w in words(s)}
    counts, n = document_frequencies(files, text, vocabulary)
    idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}
    # Which segments reach the threshold if their other words weigh least, as if in every file.
    known = Templates(templates, idf, 1.0, threshold)
    others = [f for f in files.schema.fields if f.name not in (text, "license", "score", "origin", "directory")]
    segment = "struct<digest string, own double, dots array<struct<k int, dot double>>, others array<struct<word string, n int>>>"
    kind = pa.struct([("digest", pa.string()), ("own", pa.float64()), ("dots", pa.list_(pa.struct([("k", pa.int32()), ("dot", pa.float64())]))), ("others", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())])))])

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):  # a batch of long licence files stays small
                batch = whole.slice(a, 512)
                found = [
                    [{"digest": d, "own": own, "dots": [{"k": k, "dot": x} for k, x in dots], "others": [{"word": w, "n": c} for w, c in more]} for d, (own, dots, more) in known.hopeful(t.as_py()).items()]
                    for t in batch.column(len(others))
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), batch.column(len(others) + 1), pa.array(found, pa.list_(kind))], [*(f.name for f in others), "__row", "__found"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"__row bigint, __found array<{segment}>"])
    numbered = files.select(*(f.name for f in others), F.col(text).cast("string").alias("__text"), F.monotonically_increasing_id().alias("__row"))
    read = cut_lineage(numbered.mapInArrow(state, schema))
    # A statement that many files share is weighed once.
    met = read.select("__row", F.explode("__found").alias("s"))
    segments = cut_lineage(met.groupBy(F.col("s.digest").alias("digest")).agg(F.first("s").alias("s")).select("digest", "s.own", "s.dots", "s.others"))
    wanted = cut_lineage(segments.select(F.explode("others.word").alias("word")).distinct())
    best = cut_lineage(best_of_segments(segments, frequencies_of(files, text, wanted), n, known))
    best = met.select("__row", F.col("s.digest").alias("digest")).join(best, "digest").groupBy("__row").agg(F.max("best").alias("__best"))
    stated = read.drop("__found").join(best, "__row", "left").withColumns({"license": F.col("__best.license"), "score": F.col("__best.score")}).drop("__best", "__row")
    stated = cut_lineage(stated)
    own = F.regexp_replace(F.col(path), "/?[^/]*$", "")
    stated = stated.withColumn("__own", own)
    licensed = stated.filter(F.col(path).rlike(licence_file) & F.col("license").isNotNull())
    licensed = licensed.groupBy(F.col("__own").alias("__at")).agg(F.max_by("license", F.struct("score", "license")).alias("__license"))
    above = stated.filter(F.col("__own").isNotNull()).select("__own").distinct().withColumn("__path", F.concat("__own", F.lit("/x")))
    above = above.withColumn("__path", F.when(F.col("__own") == "", "x").otherwise(F.col("__path"))).select("__own", F.explode(ancestors("__path")).alias("__at"))
    nearest = above.join(licensed, "__at").groupBy("__own").agg(F.max_by(F.struct("__at", "__license"), F.length("__at")).alias("__near"))
    nearest = cut_lineage(nearest.select(F.col("__own").alias("__dir"), F.col("__near.__at").alias("directory"), F.col("__near.__license").alias("__license")))
    joined = stated.join(nearest, F.col("__own") == F.col("__dir"), "left")
    inherits = F.col("license").isNull() & F.col("__license").isNotNull()
    return joined.select(
        *(f.name for f in others),
        F.coalesce("license", "__license").alias("license"),
        "score",
        F.when(F.col("license").isNotNull(), "stated").when(inherits, "inherited").alias("origin"),
        F.when(inherits, F.col("directory")).alias("directory"),
    )
