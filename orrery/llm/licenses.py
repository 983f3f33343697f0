"""Licence scans in SQL functions: TF-IDF cosines to templates, and inheritance by directory.

Lines that mention licence terms are the headers. Scored are the lines, the
blocks and paragraphs they form with the lines around them, as notices are
wrapped, and licence files as one text. Equal ones are scored once. An SPDX tag
names its licence without a score. A document's licence is the best of these;
without one it takes that of the nearest directory above that holds a licence
file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.tables import table
from orrery.session import written

#: Short notices by SPDX identifier, as their licences ask to have them shown.
TEMPLATES = {
    "AGPL-3.0": "Licensed under the GNU Affero General Public License version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License. Redistribution and use in source and binary forms are permitted.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License. Redistribution and use in source and binary forms are permitted.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-1.0": "Licensed under the GNU General Public License version 1.",
    "GPL-2.0": "Licensed under the GNU General Public License version 2. This program is free software.",
    "GPL-3.0": "Licensed under the GNU General Public License version 3. This program is free software.",
    "ISC": "Released under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted.",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License version 2.1.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License version 3.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
}
_free = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
_gnu = "GNU {}General Public License"
_as_is = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_neither = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
#: Whole notices and short licence texts, and short names.
NOTICES = [
    ("AGPL-3.0", _free.format("program", ":", _gnu.format("Affero "), ",", "3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", _bsd + _as_is),
    ("BSD-3-Clause", _bsd + _neither + _as_is),
    *((f"CC-{x}-4.0", f"Licensed under CC {x} 4.0.") for x in ("BY", "BY-NC", "BY-NC-ND", "BY-NC-SA", "BY-ND", "BY-SA")),
    ("GPL-1.0", _free.format("program", ";", _gnu.format(""), ";", "1").replace(" of the License,", ",")),
    ("GPL-2.0", _free.format("program", ";", _gnu.format(""), ";", "2")),
    ("GPL-3.0", _free.format("program", ":", _gnu.format(""), ",", "3")),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1", _free.format("library", ";", _gnu.format("Lesser "), ";", "2.1")),
    ("LGPL-3.0", _free.format("library", ":", _gnu.format("Lesser "), ",", "3")),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
TEMPLATE_LINES = [(k, line) for k, v in TEMPLATES.items() for line in [v, v.split(". ")[0]]] + NOTICES
#: An SPDX tag, lower-cased, with an identifier or an expression.
SPDX = r"spdx-license-identifier:\s*(\(?[a-z0-9.+-]+\)?(?: (?:and|or|with) \(?[a-z0-9.+-]+\)?)*)"
HEADER = r"(?i)licen[cs]e|copyright|spdx|warrant|permission is"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
LEAST = 0.6


def _terms(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9]+"), lambda x: x != "")


def cosines(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """``(unit, license, cosine)`` of the best template of each distinct text (columns unit: its key, line: the text, n: how often it occurs).

    Document frequencies count all occurrences. Ties go to the first licence by name.
    """
    counted = texts.select("unit", "n", F.explode(_terms("line")).alias("term")).groupBy("unit", "n", "term").agg(F.count("*").alias("tf"))
    df = counted.groupBy("term").agg(F.sum("n").alias("df"))
    top = F.lit(1.0 + texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    idf = df.select("term", (F.log(top / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    t = templates.select("license", "line", F.explode(_terms("line")).alias("term")).groupBy("license", "line", "term").agg(F.count("*").alias("tf"))
    t = t.join(idf, "term", "left").select("license", "line", "term", (F.col("tf") * F.coalesce("idf", F.log(top) + 1.0)).alias("w"))
    length = t.groupBy("license", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    t = t.join(length, ["license", "line"]).select("license", "line", "term", (F.col("w") / F.col("length")).alias("w"))
    units = counted.join(idf, "term").select("unit", "term", (F.col("tf") * F.col("idf")).alias("v"))
    size = units.groupBy("unit").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    dot = units.join(F.broadcast(t), "term").groupBy("unit", "license", "line").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    best = dot.join(size, "unit").select("unit", "license", F.round(F.col("dot") / F.col("size"), 6).alias("cosine"))
    return best.groupBy("unit").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select("unit", "b.license", (-F.col("b.c")).alias("cosine"))


def tags(texts: DataFrame) -> DataFrame:
    """``(unit, license, cosine)`` of each text with an SPDX tag; known identifiers as in ``TEMPLATES``, others and expressions lower-cased."""
    said = F.regexp_extract("line", SPDX, 1)
    known = F.create_map(*(F.lit(y) for x in TEMPLATES for y in (x.lower(), x)))
    base = F.regexp_replace(said, r"(-only|-or-later|\+)$", "")
    return texts.where(said != "").select("unit", F.coalesce(F.try_element_at(known, base), said).alias("license"), F.lit(1.0).alias("cosine"))


def blocks(text: Column, tidy) -> Column:
    """Header lines joined with lines at most two away, across blank lines and by paragraph; without marks of comments."""
    marked = F.split(F.regexp_replace(text, r"(?m)^[ \t]*(?:[#;%*]+|//+|/\*+|--|<!--|\.\.)+[ \t/]*|[ \t]*(?:\*/|-->)?[ \t\r]*$", ""), "\n")
    is_header = F.transform(marked, lambda x: x.rlike(HEADER))
    near = lambda i: F.exists(F.slice(is_header, F.greatest(i - 1, F.lit(1)), F.lit(3) + F.least(i, F.lit(2))), lambda y: y)
    kept = F.array_join(F.transform(marked, lambda x, i: F.when(near(i), x).otherwise(F.lit("\f"))), "\n")
    parts = F.concat(F.split(kept, "\f"), F.split(kept, r"\f|\n\s*\n"))
    return F.array_distinct(F.transform(F.filter(parts, lambda x: x.rlike(HEADER)), tidy))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least: float = LEAST) -> DataFrame:
    """``(doc_id, n_headers, own_license, own_cosine, license, inherited_from)`` for every row of ``docs``.

    ``own_license`` is the best template of any header line, of the block or
    paragraph around it, or of the whole text of a licence file, with a cosine of
    ``least`` or more; an SPDX tag counts as 1. ``license`` falls back
    on the licence of the nearest directory above, itself included, that holds a
    licence file with one; of several files there the first by path, then id,
    speaks. ``inherited_from`` names that directory. Null texts and paths have no
    headers and no directory; rows are judged each by their own text, also where
    ids or paths repeat; other columns are ignored; an empty table gives no rows.
    Ties go to the first licence by name.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(path_col).cast("string").alias("path"))
    is_file = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    tidy = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(HEADER)), tidy)
    none = F.array().cast("array<string>")
    headers = F.when(F.col("text").rlike(HEADER), F.array_union(lines, blocks(F.col("text"), tidy))).otherwise(none)
    whole = F.when(is_file & (F.trim("text") != ""), F.array(tidy(F.col("text")))).otherwise(none)  # whatever its words
    # rows have numbers of their own, since ids and paths may repeat; once written they stay
    numbered = src.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", is_file.alias("is_file"), F.array_union(headers, whole).alias("units"), F.size(lines).cast("long").alias("n_headers"))
    known = written(numbered, "headers")
    each = known.select(F.explode("units").alias("line")).groupBy(F.md5("line").alias("unit")).agg(F.min("line").alias("line"), F.count("*").alias("n"))
    each = written(each, "units")
    templates = spark.createDataFrame(TEMPLATE_LINES, "license string, line string")
    tagged = F.col("line").rlike(SPDX)
    scored = cosines(each.where(~tagged), templates).where(F.col("cosine") >= least)
    scored = written(scored.unionByName(tags(each)), "cosines")
    hits = known.where(F.size("units") > 0).select("row", F.explode(F.transform("units", lambda x: F.md5(x))).alias("unit")).join(scored, "unit")
    own = hits.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    own = own.select("row", F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("own_cosine"))
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit(""))
    own = written(own, "licenses")
    full = known.select("row", "doc_id", "n_headers", "is_file", F.coalesce("path", F.lit("")).alias("key"), folder.alias("dir")).join(own, "row", "left")
    said = full.where("is_file and own_license is not null").groupBy("dir").agg(F.min(F.struct("key", "doc_id", "own_license")).alias("f")).select(F.col("dir").alias("above"), F.col("f.own_license").alias("dir_license"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = full.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = dirs.join(said, "above").groupBy("dir").agg(F.max_by(F.struct("above", "dir_license"), F.length("above")).alias("n")).select("dir", "n.above", "n.dir_license")
    out = full.join(nearest, "dir", "left")
    return out.select(
        "doc_id",
        "n_headers",
        "own_license",
        "own_cosine",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("above")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as files: folders by source, language and id; every fiftieth is its folder's licence file."""
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    parts = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 500), F.floor(F.col("doc_id") / 50) % 10]
    return docs.withColumn("path", F.concat_ws("/", *(x.cast("string") for x in parts), name))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of all ``documents``, read as files."""
    return scan(document_paths(table(spark, sf_dir, "documents")))
