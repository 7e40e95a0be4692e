"""Licence scans: sparse TF-IDF cosine of headers and files to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Staging, cut, join_small, packed

# How the public licences are stated. Short notices as their publishers word them or as files cite them, the
# headers they ask for in source files, short licences in full, and of long ones the opening by which a file of them is known.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)
_GNU_COPY = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
)


def _gnu_header(name: str, version: str, what: str = "program") -> str:
    """The notice that the GNU licences ask for in source files."""
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )


TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU_COPY,
        _gnu_header("GNU Affero General Public License", "3"),
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-2-Clause": ("Released under the 2-Clause BSD License.", f"{_BSD_START} {_BSD_TWO} {_BSD_END}", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (
        "Released under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        f"{_BSD_START} {_BSD_TWO} {_BSD_THREE} {_BSD_END}",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "GFDL-1.3": (
        "GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc. " + _GNU_COPY,
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
        "SPDX-License-Identifier: GFDL-1.3-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA " + _GNU_COPY,
        _gnu_header("GNU General Public License", "2"),
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU_COPY,
        _gnu_header("GNU General Public License", "3"),
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA " + _GNU_COPY,
        _gnu_header("GNU Lesser General Public License", "2.1", "library"),
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU_COPY,
        _gnu_header("GNU Lesser General Public License", "3", "library"),
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        _MIT,
        f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
}

#: Least cosine of a match.
COSINE = 0.8
_TOKEN = re.compile(r"[^\W_]+")
_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)([.\-][^/]*)?$"


def terms(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Matcher:
    """Templates as sparse unit vectors with the corpus's IDF; words of no template share the weight of an unseen word."""

    def __init__(self, n: dict[str, int], rows: int, least: float = COSINE, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.least, self.unseen = least, math.log(rows + 1) + 1
        known = {w for texts in templates.values() for t in texts for w in terms(t)}
        self.idf = {w: math.log((rows + 1) / (n.get(w, 0) + 1)) + 1 for w in known}
        self.names, self.postings = [], {}
        #: A run of lines is followed to twice the words of the longest template.
        self.longest = 2 * max(len(terms(t)) for texts in templates.values() for t in texts)
        vectors = []
        for name in sorted(templates):
            for text in templates[name]:
                v = self._weights(Counter(terms(text)))
                size = math.sqrt(sum(x * x for x in v.values()))
                vectors.append({w: x / size for w, x in v.items()})
                for w, x in vectors[-1].items():
                    self.postings.setdefault(w, []).append((len(self.names), x))
                self.names.append(name)
        # A text that only has words outside `telling` has, by Cauchy and Schwarz, a cosine below `least` to each template.
        left = [0.0] * len(vectors)
        self.telling = set(known)
        for w in sorted(known, key=lambda w: (self.idf[w], w)):
            after = [x + v.get(w, 0.0) ** 2 for x, v in zip(left, vectors, strict=True)]
            if max(after) < 0.999 * least * least:
                left = after
                self.telling.discard(w)

    def _weights(self, counts: Counter) -> dict[str, float]:
        get, unseen = self.idf.get, self.unseen
        return {w: (1 + math.log(c)) * get(w, unseen) for w, c in counts.items()}

    def best(self, words: Sequence[str]) -> tuple[float, str] | None:
        """The largest cosine of at least `least`, and its licence; ties by the licence's name."""
        if self.telling.isdisjoint(words):
            return None
        v = self._weights(Counter(words))
        scores: dict[int, float] = {}
        for w, x in v.items():
            for i, y in self.postings.get(w, ()):
                scores[i] = scores.get(i, 0.0) + x * y
        size = math.sqrt(sum(x * x for x in v.values()))
        found = [(round(s / size, 9), self.names[i]) for i, s in scores.items() if s / size >= self.least]
        return min(found, key=lambda f: (-f[0], f[1])) if found else None

    def best_run(self, lines: list[list[str]]) -> tuple[float, str] | None:
        """The best match of two or more lines in a row, as best() would find it for each such run.

        A run starts and ends at a line with a template's word, as others only lower a cosine. It grows word by word,
        and so do its products with the templates.
        """
        known = [not self.idf.keys().isdisjoint(line) for line in lines]
        out = None
        for i in range(len(lines)):
            if not known[i]:
                continue
            counts: dict[str, int] = {}
            scores: dict[int, float] = {}
            square, n = 0.0, 0
            for j in range(i, len(lines)):
                n += len(lines[j])
                if n > self.longest:
                    break
                for w in lines[j]:
                    c = counts[w] = counts.get(w, 0) + 1
                    idf = self.idf.get(w, self.unseen)
                    old, new = (1 + math.log(c - 1)) * idf if c > 1 else 0.0, (1 + math.log(c)) * idf
                    square += new * new - old * old
                    for t, y in self.postings.get(w, ()):
                        scores[t] = scores.get(t, 0.0) + (new - old) * y
                if j > i and known[j]:
                    size = self.least * math.sqrt(square)
                    for t, x in scores.items():
                        if x >= size:
                            found = (round(x / math.sqrt(square), 9), self.names[t])
                            out = found if out is None else min(out, found, key=lambda f: (-f[0], f[1]))
        return out

    def scan(self, text: str | None) -> tuple[float, str, bool] | None:
        """(cosine, licence, whether the text as a whole matches), from the whole text, its lines and runs of lines.

        Comment marks and empty lines are no words, so a notice wrapped over commented lines is a run.
        """
        if not text:
            return None
        lines = [w for w in map(terms, text.split("\n")) if w]
        every = [w for line in lines for w in line]
        if self.telling.isdisjoint(every):
            return None
        whole = self.best(every)
        found = [f for f in (*map(self.best, lines), self.best_run(lines), whole) if f]
        return (*min(found, key=lambda f: (-f[0], f[1])), whole is not None) if found else None


def _counts(df: DataFrame, words: set[str]) -> tuple[dict[str, int], int]:
    """In how many rows of the whole table (text) each of the templates' words occurs, and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen[""] += batch.num_rows
            for text in batch.column("text"):
                if t := text.as_py():
                    seen.update(words.intersection(terms(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    found = {r["word"]: r["n"] for r in df.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.get("", 0)


def scan_licenses(df: DataFrame, *, text_col: str = "text", path_col: str = "path", least: float = COSINE, headers_declare: bool = False) -> DataFrame:
    """(row struct, license, cosine double, origin, declared_in) of every row.

    origin `file`: the whole text is a template; `header`: a line or run of lines of it is; `inherited`: neither, but the nearest
    directory above the row's path holds a licence file (a `file` row, or a row named LICENSE, COPYING or NOTICE with
    any match; with headers_declare also rows with a header): its licence, the most frequent where it has several,
    then the first by name, with the directory in declared_in; else `none`, all else null. Document frequencies are
    counted over the whole table; whole texts are read. A null text has no licence of its own, a null path no
    directory; repeated rows fare alike; an empty table gives an empty result. Columns of df stay inside row.

    Directories are aggregated before any join: one row per directory that declares something, one per directory and
    ancestor. Texts meet those tables by a broadcast within its checked size, else by directory.
    """
    spark = df.sparkSession
    held = packed(df).select("row", F.col(f"row.`{text_col}`").alias("text"), F.regexp_replace(F.col(f"row.`{path_col}`"), "/+", "/").alias("path"))
    held = held.withColumn("key", F.xxhash64("text")).withColumn("check", F.xxhash64(F.lit(1), F.col("text")))
    held = held.withColumn("dir", F.regexp_extract(F.concat(F.lit("/"), F.regexp_replace("path", "^/", "")), "^(.*)/[^/]*$", 1))
    vocabulary = {w for texts in TEMPLATES.values() for t in texts for w in terms(t)}
    n, rows = _counts(held.select("text"), vocabulary)
    shared = spark.sparkContext.broadcast(Matcher(n, rows, least))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.scan(t.as_py()) for t in batch.column("text")]
            own = [pa.array([g[i] if g else None for g in got], kind) for i, kind in ((1, pa.string()), (0, pa.float64()), (2, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own], [*names, "own", "cosine", "whole"])

    names = ["path", "dir", "key", "check"]
    stage = Staging(spark)
    try:
        narrow = held.select("text", *names)
        verdicts = stage.table(narrow.mapInArrow(scan, "path string, dir string, key long, check long, own string, cosine double, whole boolean"))
        # few texts have a licence of their own: the rows get theirs from a table of those texts
        own = cut(verdicts.where(F.col("own").isNotNull()).groupBy("key", "check").agg(*(F.first(c).alias(c) for c in ("own", "cosine", "whole"))))
        declares = F.col("whole") | F.col("path").rlike(_FILE_NAME) | F.lit(headers_declare)
        counted = verdicts.where(F.col("own").isNotNull() & F.col("dir").isNotNull() & declares).groupBy("dir", "own").agg(F.count("*").alias("n"))
        declared = stage.table(counted.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("x")).select(F.col("dir").alias("at"), F.col("x.own").alias("given")))
        folders = verdicts.where(F.col("own").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
        parts = F.split("dir", "/")
        above = folders.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("at"))
        nearest = join_small(above, declared, "at").groupBy("dir").agg(F.max(F.struct(F.length("at").alias("n"), "at", "given")).alias("x"))
        inherited = cut(nearest.select(F.col("dir").alias("d"), F.col("x.at").alias("declared_in"), F.col("x.given").alias("given")))
    finally:
        stage.close()
    scanned = join_small(held, own.withColumnRenamed("key", "k").withColumnRenamed("check", "c"), (F.col("key") == F.col("k")) & (F.col("check") == F.col("c")), "left")
    out = join_small(scanned, inherited, (F.col("dir") == F.col("d")) & F.col("own").isNull(), "left")
    origin = F.when(F.col("whole"), "file").when(F.col("own").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("row", F.coalesce("own", "given").alias("license"), "cosine", origin.alias("origin"), "declared_in")


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    out = scan_licenses(docs.select("doc_id", "text", path.alias("path")))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("row.path").alias("path"), "license", "cosine", "origin", "declared_in")
