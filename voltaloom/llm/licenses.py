"""Licence scans: sparse TF-IDF cosine of header lines to notice templates, and inheritance from directories.

Windows of one to three lines of a text are compared with notice templates, whole texts with licence texts; term weights come from the counts of the
templates' words over all documents. An inverted index with an exact bound skips what cannot reach the cosine. A text that is a licence text, or of which at least
half the words stand in a window that matches a notice, is a licence file and licenses its directory; a document without a notice takes the licence of the nearest ancestor directory that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaloom.llm.common import materialize, small, spread_join

# Short notices as they are commonly written, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted; BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "Proprietary": "All rights reserved",
}
# Whole texts of licence files, without the copyright line.
FILES = {
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
        " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
        " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;"
        " OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,"
        " ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        " THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
        " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}
COSINE, FILE_SHARE, LINES = 0.6, 0.5, 3
#: Cosine of a whole text with a whole licence text from which it is one.
FILE_COSINE = 0.8

_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*|\d+(?:\.\d+)*")


def _terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_VOCABULARY = frozenset(w for t in (*TEMPLATES.values(), *FILES.values()) for w in _terms(t))


def _count(batches):
    for batch in small(batches):
        seen, n = Counter(), 0
        for t in batch.column("text").to_pylist():
            n += 1
            seen.update(_VOCABULARY.intersection(_terms(t or "")))
        names = [*seen, ""]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*seen.values(), n], pa.int64())], ["term", "df"])


class Index:
    """Templates as unit vectors, by term, and the terms of which a text must hold one to reach a cosine.

    The cosine with a template is at most the length of the template's part that a text shares. A template's lightest terms that
    together stay below the cosine cannot reach it alone, so a text without any of the others is not compared; nothing is lost.
    """

    def __init__(self, vectors: dict[str, dict[str, float]], cosine: float):
        self.names, self.cosine = sorted(vectors), cosine
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        self.heavy: set[str] = set()
        for k, name in enumerate(self.names):
            total = 0.0
            for w, x in sorted(vectors[name].items(), key=lambda p: (p[1], p[0])):
                self.by_term.setdefault(w, []).append((k, x))
                total += x * x
                if total >= cosine * cosine - 1e-9:
                    self.heavy.add(w)

    def may_reach(self, terms) -> bool:
        """Whether some template's part in a set of terms is long enough."""
        length = [0.0] * len(self.names)
        for w in terms:
            for k, x in self.by_term.get(w, ()):
                length[k] += x * x
        return max(length, default=0.0) >= self.cosine * self.cosine - 1e-9

    def best(self, vector: dict[str, float]) -> tuple[float, str | None]:
        """(cosine, name) of the nearest template; the first by name of equals."""
        score = [0.0] * len(self.names)
        for w, v in vector.items():
            for k, x in self.by_term.get(w, ()):
                score[k] += v * x
        k = max(range(len(score)), key=lambda k: (score[k], -k), default=None)
        return (0.0, None) if k is None else (score[k], self.names[k])


class Matcher:
    def __init__(self, df: dict[str, int], n: int, templates: dict[str, str] = TEMPLATES, files: dict[str, str] = FILES):
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for t in (*templates.values(), *files.values()) for w in _terms(t)}
        self.rare = math.log(1 + n) + 1  # of words in no template
        self.notices = Index({k: self.vector(Counter(_terms(t))) for k, t in templates.items()}, COSINE)
        self.files = Index({k: self.vector(Counter(_terms(t))) for k, t in files.items()}, FILE_COSINE)

    def vector(self, counts: Counter) -> dict[str, float]:
        v = {w: (1 + math.log(c)) * self.idf.get(w, self.rare) for w, c in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    def best(self, text: str) -> tuple[float, str | None]:
        return self.notices.best(self.vector(Counter(_terms(text))))

    def scan(self, text: str | None) -> tuple[str | None, float, bool]:
        """(licence, cosine, whether the text is a licence file) of a whole text."""
        if not text:
            return None, 0.0, False
        every = set(_terms(text))
        if not self.files.heavy.isdisjoint(every) and self.files.may_reach(every):
            score, name = self.files.best(self.vector(Counter(_terms(text))))
            if score >= FILE_COSINE:
                return name, round(score, 9), True
        if self.notices.heavy.isdisjoint(every) or not self.notices.may_reach(every):
            return None, 0.0, False
        found, covered = (0.0, None), set()
        lines = [_terms(x) for x in text.split("\n")]
        known = [self.notices.by_term.keys() & x for x in lines]
        for k in [k for k, x in enumerate(known) if not self.notices.heavy.isdisjoint(x)]:
            for lo in range(max(0, k - LINES + 1), k + 1):
                for hi in range(k + 1, min(len(lines), lo + LINES) + 1):
                    if not self.notices.may_reach(set().union(*known[lo:hi])):
                        continue
                    score, name = self.notices.best(self.vector(Counter(w for x in lines[lo:hi] for w in x)))
                    if score >= COSINE:
                        covered.update(range(lo, hi))
                        if score > found[0] + 1e-12:
                            found = (score, name)
        if not covered:
            return None, 0.0, False
        return found[1], round(found[0], 9), sum(len(lines[k]) for k in covered) >= FILE_SHARE * sum(map(len, lines))


def _scan(matcher: Matcher):
    def run(batches):
        for batch in small(batches):
            rows = [matcher.scan(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), *cols], ["doc_id", "path", "own", "cosine", "is_file"])

    return run


def scan_licenses(documents: DataFrame, path: Column) -> DataFrame:
    """doc_id, path, license, how (header, file, inherited, none), cosine, from_dir for each row of documents.

    Null and empty texts and paths: no notice; null paths inherit nothing. Of several licence files in a directory the most frequent licence
    counts, of equals the first by name. Ties of cosine go to the first template by name.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.col("text").cast("string").alias("text"))
    counted = {r.term: r.df for r in docs.select("text").mapInArrow(_count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # words of the templates at most
    matcher = Matcher({k: v for k, v in counted.items() if k}, counted.get("", 0))
    scanned = materialize(docs.mapInArrow(_scan(matcher), "doc_id long, path string, own string, cosine double, is_file boolean"), "license-scan")
    scanned = scanned.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    votes = scanned.where("is_file").groupBy("dir", "own").agg(F.count("*").alias("votes"))
    licensed = votes.groupBy("dir").agg(F.min_by("own", F.struct(-F.col("votes"), F.col("own"))).alias("license"))
    dirs = scanned.where("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("up"))
    above = materialize(above, "license-above")  # the topmost directory lies above all others
    near = spread_join(above, licensed.withColumnRenamed("dir", "up"), ["up"], ["dir"]).groupBy("dir").agg(F.max_by(F.struct("license", "up"), F.length("up")).alias("from"))
    out = spread_join(scanned, near, ["dir"], ["doc_id", "path"], "left")
    how = F.when(F.col("own").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("from").isNotNull(), "inherited").otherwise("none")
    inherited = F.when(F.col("own").isNull(), F.col("from.up"))
    return out.select("doc_id", "path", F.coalesce("own", "from.license").alias("license"), how.alias("how"), "cosine", inherited.alias("from_dir"))
