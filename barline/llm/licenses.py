"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm._spark import written

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. """
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software
    Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be
    useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more
    details. You should have received a copy of the {name} along with this program. If not, see https://www.gnu.org/licenses/."""


#: Usual header lines, notices and licence texts, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT License"),
    (
        "MIT",
        """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
    (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
    sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """
        + _WARRANTY,
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
    may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
    distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
    for the specific language governing permissions and limitations under the License.""",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("GNU General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("GNU General Public License", "3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu("GNU Lesser General Public License", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gnu("GNU Affero General Public License", "3")),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", "BSD 3-Clause License. " + _BSD + _BSD_THIRD + _BSD_WARRANTY),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 2-Clause License."),
    ("BSD-2-Clause", "BSD 2-Clause License. " + _BSD + _BSD_WARRANTY),
    (
        "ISC",
        """ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
    the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
    REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
    INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
    OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
    from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
    and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
    wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
    notice may not be removed or altered from any source distribution.""",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
    obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "EPL-2.0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
    https://www.eclipse.org/legal/epl-2.0/""",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
    this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
]

#: A unit (its words, lower-case, joined by blanks) is compared if it holds one of these; each template does. A line of code begins otherwise
#: than a comment or an empty line does.
CUES = ["licen", "redistribut", "public domain", "permission", "warrant"]
COMMENT = r"^\s*(#|//|/?\*|--|;|%|<!--|\(\*|$)"
FILE_NAMES = "(?i)^(LICEN[CS]E|COPYING|UNLICENSE|NOTICE)([.-].*)?$"
LEAST = 0.6
#: Tasks that share the files of a wording or of a directory.
SALTS = 16


def _worded(text: Column) -> Column:
    """The words of a text, lower-case, joined by blanks; comment signs and line breaks are gone."""
    return F.array_join(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""), " ")


def _cued(text: Column) -> Column:
    found = F.lit(False)
    for cue in CUES:
        found = found | F.contains(text, F.lit(cue))
    return found


def _named() -> Column:
    return F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAMES), F.lit(False))


def template_terms(spark: SparkSession) -> DataFrame:
    """A row for each template and token: template, license, token, tf."""
    rows = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("line")) for i, (n, t) in enumerate(TEMPLATES)))))
    return rows.select("template", "license", F.explode(F.split(_worded(F.col("line")), " ")).alias("token")).groupBy("template", "license", "token").agg(F.count(F.lit(1)).alias("tf"))


def units(files: DataFrame) -> DataFrame:
    """path, id, unit: what is compared of each file, by its words: its lines, its paragraphs, its header (the comments before the first line of
    code) and, of a file that is named like a licence, the whole; as far as cued. id is the MD5 of the words.
    """
    held = files.where(_cued(F.lower("text")) | _named()).select("path", "text", F.split("text", "\n").alias("lines"), _named().alias("named"))
    code = F.array_position(F.transform("lines", lambda x: x.rlike(COMMENT)), False).cast("int")
    header = F.array_join(F.slice("lines", 1, F.when(code == 0, F.size("lines")).otherwise(code - 1)), " ")
    parts = F.concat(F.col("lines"), F.split("text", "\\n[^A-Za-z0-9\\n]*\\n"), F.array(header), F.when(F.col("named"), F.array("text")).otherwise(F.array().cast("array<string>")))
    # cues are sought before words are joined, so that other lines cost nothing more
    made = held.select("path", F.explode(F.array_distinct(F.transform(F.filter(parts, lambda x: _cued(F.lower(x)) | F.contains(F.lower(x), F.lit("public"))), _worded))).alias("unit"))
    return made.where(_cued(F.col("unit"))).select("path", F.unhex(F.md5(F.col("unit").cast("binary"))).alias("id"), "unit")


def stated(files: DataFrame, least: float = LEAST) -> DataFrame:
    """path, license, score of each file with a unit like a template; of several units the likest, ties by licence name.

    idf is ln((1 + n) / (1 + df)) + 1 over the n distinct units of the whole corpus and the templates; units occur as they are
    worded, so a header that a million files share is one unit. Tokens carry a unit's id, not its text.
    """
    spark = files.sparkSession
    held = written(units(files), "units")
    worded = held.groupBy("id").agg(F.any_value("unit").alias("unit"))
    terms = written(worded.select("id", F.explode(F.split("unit", " ")).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf")), "terms")
    templates = template_terms(spark)
    seen = terms.select("token").union(templates.select("token"))
    n = held.agg((F.count_distinct("id") + len(TEMPLATES)).alias("n")).scalar()
    idf = written(seen.groupBy("token").agg(F.count(F.lit(1)).alias("df")).select("token", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    weight = F.col("tf") * F.col("idf")
    model = templates.join(idf, "token").select("template", "license", "token", "idf", weight.alias("u"))
    model = written(model.withColumn("unorm", F.sqrt(F.sum(F.col("u") * F.col("u")).over(Window.partitionBy("template")))), "model")
    # the templates' tokens, which are most units' too, are few and broadcast; only the rest meet their idf by a shuffle
    common = F.broadcast(model.select("token", "idf").distinct())
    weighted = terms.join(common, "token").unionByName(terms.join(common, "token", "left_anti").join(idf, "token"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    dots = terms.join(F.broadcast(model), "token").groupBy("id", "template", "license", "unorm").agg(F.sum(weight * F.col("u")).alias("dot"))
    alike = dots.join(norms, "id").select("id", "license", F.round(F.col("dot") / (F.col("norm") * F.col("unorm")), 6).alias("score"))
    best = written(alike.where(F.col("score") >= least).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("b")), "best")
    dealt = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = held.select("path", "id", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt")).join(dealt, ["id", "salt"])
    return met.groupBy("path").agg(F.min("b").alias("b")).select("path", "b.license", (-F.col("b.low")).alias("score"))


def scan(files: DataFrame, share: float = 0.1, least: float = LEAST) -> DataFrame:
    """files: path (absolute, / between parts), text (others ignored). Returns path, license, score, origin, from_dir, a row for
    each row.

    origin: `stated` by the file itself, else `inherited` from the nearest ancestor directory (its own first) that holds a
    licence file, else null with no licence. A licence file states a licence and is named like one, or has `share` of its words
    in cued lines. Of several licence files of a directory the first path counts. The join goes over
    distinct directories and their ancestors, not over files.

    Null or empty text states nothing. Null path: neither states nor inherits. Repeated paths: each row gets the same result, by
    all the path's texts. Ties go to the smaller licence name. Very long texts: read whole, a row for each cued line and paragraph. No rows: no rows.
    """
    files = files.select("path", "text")
    own = written(stated(files.where("path is not null"), least), "stated")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    cued = F.filter(F.split("text", "\n"), lambda x: _cued(_worded(x)))
    words = lambda x: F.size(F.split(x, "\\s+"))
    named = files.where(_named() | (_cued(F.lower("text")) & (words(F.array_join(cued, " ")) >= share * words(F.col("text"))))).select("path").distinct()
    sources = own.join(named, "path").select("path", "license", parent.alias("dir")).groupBy("dir").agg(F.min_by("license", "path").alias("license"))
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt")
    every = files.select("path", parent.alias("dir"), salt)
    dirs = every.select("dir").where("dir is not null").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/").alias("from_dir"))
    near = up.join(sources.withColumnRenamed("dir", "from_dir"), "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "license"), "depth").alias("near"))
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = every.join(own, "path", "left").join(near, ["dir", "salt"], "left")
    got = F.col("license").isNotNull()
    return joined.select(
        "path",
        F.coalesce("license", "near.license").alias("license"),
        "score",
        F.when(got, "stated").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(~got, F.col("near.from_dir")).alias("from_dir"),
    )
