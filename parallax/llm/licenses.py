"""License scans, in SQL expressions alone.

Units of files, namely lines, sentences, paragraphs (which joins wrapped lines), blocks of comment lines, the first block and
whole texts, are compared with license templates by the cosine of sparse TF-IDF vectors. Document frequencies of all words are
counted over all files; words in a share of ``RARE`` of the files or fewer weigh alike, so scores do not depend on how many
files there are. Only units with an anchor, a word without which no template reaches ``COSINE``, are compared.

A unit's license is that of its nearest template. Among the units of a file evidence decides: the weight that the unit has in
common with the template, its length along it, so that two hundred words of terms outweigh a phrase, however exact. A bare
notice of reserved rights counts only where nothing else is found.

A file speaks for its directory if its whole text, or a unit of at least ``FILE_SHARE`` of it, is a license, if it begins with
the title of a license text, or if it has a license and is named as license files are. Files without a license of their own
inherit from the nearest ancestor directory that has one, found by joins on paths of directories, not of files.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import keyed, ready, stored

COSINE = 0.6
FILE_SHARE = 0.5
RARE = 0.001
#: Words and their weights that are broadcast; a larger table is joined by shuffle. Words over ``RARE`` are at most the
#: mean number of distinct words of a file divided by it.
BROADCAST_WORDS = 200_000
LICENSE_FILE = r"(^|/)(licen[cs]e|copying|unlicense)([._-][^/]*)?$"
UNITS = "array<struct<kind:int,said:string>>"
LINE, PARAGRAPH, COMMENT, HEAD, WHOLE = range(5)
#: A line that is no comment, of which comment blocks are the rest.
CODE_LINE = r"(?m)^(?![ \t]*(?:#|//|--|;|%|/?\*)).*$"

#: How files say under which license they are.
MIT_TERMS = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
ISC_TERMS = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", MIT_TERMS),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        APACHE_NOTICE,
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        GNU_NOTICE.format("General Public"),
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", GNU_NOTICE.format("Lesser General Public")),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", GNU_NOTICE.format("Affero General Public")),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", BSD_START + BSD_NAMES + BSD_END),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", BSD_START + BSD_END),
    "ISC": ("Released under the ISC License.", ISC_TERMS),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.",),
}
#: Licenses that are found only where no other is, and titles with which whole license texts begin.
LAST = ("Proprietary",)
TITLES = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License", "Attribution 4.0 International"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License", "Attribution-NonCommercial 4.0 International"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public License", "Attribution-ShareAlike 4.0 International"),
    "CC0-1.0": ("CC0 1.0 Universal",),
}


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def idf_of(seen: int, n: int) -> float:
    return min(math.log((1 + n) / (1 + seen)), -math.log(RARE)) + 0.1


class Scanner:
    """Templates weighed by frequencies over all files, the words they need, and the weights of all words."""

    def __init__(self, files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, titles: dict[str, tuple[str, ...]] = TITLES):
        listed = [(name, t, title) for title, table in ((False, templates), (True, titles)) for name, texts in table.items() for t in texts]
        vocabulary = sorted({w for _, t, _ in listed for w in template_words(t)})
        self.n = files.count()
        seen = files.select(F.explode(split_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        known = F.col("w").isin(vocabulary)
        self.seen = stored(seen.filter(known | (F.col("n") > RARE * self.n)), "words")
        counts = {r["w"]: r["n"] for r in self.seen.filter(known).collect()}  # a row for each word of the templates
        self.idf = {w: idf_of(counts.get(w, 0), self.n) for w in vocabulary}
        self.names: list[str] = []
        self.vectors: list[dict[str, float]] = []
        for name, t, _ in listed:
            weights = {w: template_words(t).count(w) * self.idf[w] for w in template_words(t)}
            size = math.sqrt(sum(x * x for x in weights.values()))
            self.names.append(name)
            self.vectors.append({w: x / size for w, x in weights.items()})
        #: The templates that are titles, by their order in a score.
        self.titles = [-i for i, (*_, title) in enumerate(listed) if title]
        self.anchors = self.needed()

    def needed(self) -> list[str]:
        """Words without which what is left of each template is under the cosine."""
        chosen: set[str] = set()
        for vector in self.vectors:
            left = sum(x * x for w, x in vector.items() if w not in chosen)
            for w in sorted(vector, key=lambda w: (-self.idf[w], w)):
                if left < (COSINE * 0.999) ** 2:
                    break
                if w not in chosen:
                    chosen.add(w)
                    left -= vector[w] ** 2
        return sorted(chosen)

    def units(self, text: Column) -> Column:
        """The units of a text that have an anchor; null if it has none itself."""
        anchors = F.array(*map(F.lit, self.anchors))

        def of(kind: int, said: Column) -> Column:
            return F.transform(said, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("said")))

        lines = F.split(text, r"[\r\n]+|(?<=[.!?])\s+")
        paragraphs = F.filter(F.split(text, r"[\r\n][^A-Za-z0-9\r\n]*+(?:\r\n|\n|\r)[\r\n]*"), lambda s: F.rlike(s, F.lit(r"[\r\n]")))
        comments = F.filter(F.split(text, CODE_LINE), lambda s: F.rlike(s, F.lit(r"[^\r\n][\r\n]+[^\r\n]")))
        head = F.array(F.get(F.filter(F.split(text, r"[\r\n][^A-Za-z0-9\r\n]*+(?:\r\n|\n|\r)[\r\n]*"), lambda s: F.rlike(s, F.lit("[A-Za-z0-9]"))), F.lit(0)))
        parts = F.filter(F.concat(of(LINE, lines), of(PARAGRAPH, paragraphs), of(COMMENT, comments), of(HEAD, head)), lambda u: F.arrays_overlap(split_words(u["said"]), anchors))
        return F.when(F.arrays_overlap(split_words(text), anchors), F.concat(parts, of(WHOLE, F.array(text))).cast(UNITS))

    def scores(self, units: DataFrame) -> DataFrame:
        """(row, unit, evidence, score, order, license) of the nearest template to each unit of (row, unit, said), if at the cosine."""
        spark = units.sparkSession
        words = units.select("row", "unit", F.explode(F.split(F.lower("said"), "[^a-z0-9]+")).alias("w")).filter("w != ''").groupBy("row", "unit", "w").agg(F.count(F.lit(1)).alias("tf"))
        rare = F.lit(-math.log(RARE))
        idf = self.seen.select("w", (F.least(F.log((1 + F.lit(self.n)) / (1 + F.col("n"))), rare) + 0.1).alias("idf"))
        if idf.count() <= BROADCAST_WORDS:
            idf = F.broadcast(idf)
        weights = json.dumps([{"w": w, "weights": [v.get(w, 0.0) for v in self.vectors]} for w in self.idf])
        of_templates = spark.range(1).select(F.explode(F.from_json(F.lit(weights), "array<struct<w:string,weights:array<double>>>")).alias("t")).select("t.*")
        x = F.col("tf") * F.coalesce("idf", idf_of(0, 1 / RARE**2) * F.lit(1.0))
        weighed = words.join(idf, "w", "left").join(F.broadcast(of_templates), "w", "left").select("row", "unit", "weights", x.alias("x"))
        dots = [F.sum(F.col("x") * F.coalesce(F.get("weights", F.lit(i)), F.lit(0.0))).alias(f"d{i}") for i in range(len(self.vectors))]
        sums = weighed.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
        each = F.array(*[F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 6).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("license")) for i, name in enumerate(self.names)])
        nearest = sums.select("row", "unit", "norm", F.array_max(each).alias("m")).filter(F.col("m.score") >= COSINE)
        return nearest.select("row", "unit", F.round(F.col("m.score") * F.col("norm"), 4).alias("evidence"), "m.*")


def split_words(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")), "")


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(file_id, path, license, score, origin, directory) for each row of ``files`` (file_id, path, text).

    origin: own, inherited or none; directory: where an inherited license comes from. Null texts are
    empty, null paths lie in the root directory. Of several license files in one directory the one with the most evidence, then
    the first license by name, then the first path speaks for it. Repeated rows stay. ``score`` is the cosine of the unit that decides.
    """
    ready(files.sparkSession)
    files = files.select("file_id", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scanner = Scanner(files, templates)
    found = files.select(F.monotonically_increasing_id().alias("row"), "file_id", "path", F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1).alias("dir"), F.length("text").alias("size"), scanner.units(F.col("text")).alias("units"))
    found = stored(found, "files")  # numbers of rows, once stored, stay
    units = found.filter("units IS NOT NULL").select("row", "size", "path", F.posexplode("units").alias("unit", "u")).select("row", "size", "path", "unit", "u.kind", "u.said")
    scored = scanner.scores(units.select("row", "unit", "said")).join(units.select("row", "unit", "kind", "size", "path", F.length("said").alias("length")), ["row", "unit"])
    m = F.struct((~F.col("license").isin(*LAST)).alias("real"), "evidence", "score", "order", "license")
    title = (F.col("kind") == HEAD) & F.col("order").isin(*scanner.titles)
    aloud = (F.col("kind") == WHOLE) | (F.col("length") >= FILE_SHARE * F.col("size")) | title | F.rlike(F.lower("path"), F.lit(LICENSE_FILE))
    best = scored.groupBy("row").agg(F.max(m).alias("m"), F.max(F.when(aloud, m)).alias("file"))
    rows = stored(found.drop("units", "size").join(best, "row", "left"), "licenses")

    speaks = rows.filter("file IS NOT NULL").groupBy("dir").agg(F.min(F.struct((~F.col("file.real")).alias("last"), (-F.col("file.evidence")).alias("e"), F.col("file.license").alias("license"), "path")).alias("top"))
    speaks = stored(speaks.select(F.col("dir").alias("above"), F.col("top.license").alias("inherited")), "speaks")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    dirs = rows.select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above").dropDuplicates(["dir", "above"])
    nearest = keyed(dirs, speaks, speaks.count(), "above", "dir").groupBy("dir").agg(F.max(F.struct("depth", "above", "inherited")).alias("from"))
    nearest = stored(nearest, "nearest")
    joined = keyed(rows, nearest, nearest.count(), "dir", "row", "left")
    own = F.col("m").isNotNull()
    return joined.select(
        "file_id",
        "path",
        F.when(own, F.col("m.license")).otherwise(F.col("from.inherited")).alias("license"),
        F.col("m.score").alias("score"),
        F.when(own, "own").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("from.above")).alias("directory"),
    )
