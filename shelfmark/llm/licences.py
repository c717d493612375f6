"""Licence scan with DataFrame functions only: TF-IDF cosine to templates, then inheritance by path.

A text is compared as a whole, by comment blocks (headers), by paragraphs with their wrapped
lines joined, and by lines and sentences; equal pieces are one *statement*, so a notice that a
third of all files carry is scored once. Terms are weighted by their frequency in the piece and
their rarity among all texts. A piece is a candidate if it shares a rare term with a template:
one of the heaviest terms, without which the rest of the template is too light to reach the
least cosine, so that no match is lost. A file has the licence of its best piece. A file
without one inherits that of the licence file in the nearest directory above it: directories,
not files, are joined to their ancestors, so a huge directory costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.session import cut

LEAST = 0.6
SALTS = 16
# Texts of licences, their titles and the headers and notices by which files name them.
GNU_HEADER = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by "
    "the Free Software Foundation; either version {} of the License, or (at your option) any later version."
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: "
)
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU = (
    ("GPL-2.0", "General Public License", "2", "June 1991"), ("GPL-3.0", "General Public License", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"), ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
)
NAMES = ("Apache-2.0", "MIT", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0", *[g[0] for g in GNU])
TEMPLATES = (
    *[(name, f"SPDX-License-Identifier: {name}") for name in NAMES],
    *[(name, GNU_HEADER.format(kind, version)) for name, kind, version, _ in GNU],
    *[(name, f"GNU {kind} Version {version}, {date}") for name, kind, version, date in GNU],
    *[(name, f"This work is licensed under the GNU {kind}, version {version}") for name, kind, version, _ in GNU],
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", MIT_GRANT),
    ("MIT", MIT_GRANT + MIT_REST),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("BSD-2-Clause", BSD_TWO + BSD_REST),
    ("BSD-2-Clause", "Released under the 2-clause BSD License"),
    ("BSD-3-Clause", BSD_TWO + BSD_THIRD + BSD_REST),
    ("BSD-3-Clause", "Released under the 3-clause BSD License"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
#: A line that opens with no comment sign, and a line end before a line without letters and digits.
CODE_LINE = r"(?m)^(?![ \t]*(?:/?\*|//|#|--|;|%|<!--))[^\n]*$"
BLANK_LINE = r"\n[^\p{L}\p{N}\n]*(?=\n)"
SENTENCE_END = r"[\r\n]+|(?<=[.!?;])\s+"


def terms(statement: Column) -> Column:
    return F.filter(F.split(F.lower(statement), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def pieces(text: Column) -> Column:
    """What is compared of a text: all of it, its comment blocks, paragraphs, lines and sentences."""
    return F.concat(
        F.array(text), F.split(F.regexp_replace(text, CODE_LINE, "\u0001"), "\u0001[\u0001\r\n]*"),
        F.regexp_extract_all(text, F.lit(r"(?s)/\*.*?\*/"), F.lit(0)), F.split(text, BLANK_LINE), F.split(text, SENTENCE_END),
    )


def weighted(statements: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) from the term's count in the statement and its rarity."""
    tokens = statements.select(key, F.explode(terms(F.col("statement"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    mine = idf.join(tokens.select("term").distinct(), "term", "left_semi")  # only these are copied for each salt
    salted = mine.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tokens = tokens.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return tokens.join(salted, ["term", "salt"]).select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def rarities(texts: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """(term, idf) of all terms of all texts and templates; a text counts a term once."""
    counted = texts.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term"), F.lit(1).alias("one"))
    named = known.select(F.explode(F.array_distinct(terms(F.col("statement")))).alias("term"), F.lit(0).alias("one"))
    df = counted.unionByName(named).groupBy("term").agg(F.sum("one").alias("df"))
    total = texts.agg(F.count(text).alias("n"))
    return df.join(F.broadcast(total)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def rare_terms(template_terms: DataFrame, least: float) -> list[str]:
    """Terms of which every match has one: without its heaviest terms a template's unit vector is shorter than ``least``."""
    lighter = Window.partitionBy("template").orderBy("t_w", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = template_terms.withColumn("rest", F.sqrt(F.sum(F.col("t_w") * F.col("t_w")).over(lighter)))
    rows = reach.where(F.col("rest") >= least - 1e-6).select("term").distinct().collect()  # at most the templates' words
    return sorted(r[0] for r in rows)


def templates_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(template, licence, statement) from the parameter; none gives no rows."""
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("template"), F.lit(name).alias("licence"), F.lit(text).alias("statement")) for i, (name, text) in enumerate(templates)])
    return spark.range(1).select(F.inline(rows.cast("array<struct<template: bigint, licence: string, statement: string>>")))


def notices(texts: DataFrame, key: str, text: str, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(key, licence, cosine): the best piece of each text that has one. Equal cosines: the first licence by name."""
    texts = texts.where(F.col(text).isNotNull()).select(key, text)
    known = templates_table(texts.sparkSession, templates)
    idf = cut(rarities(texts, known, text))
    template_terms = weighted(known, idf, "template")
    template_norm = template_terms.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    template_terms = template_terms.join(template_norm, "template").join(known.select("template", "licence"), "template")
    template_terms = cut(template_terms.select("term", "template", "licence", (F.col("w") / F.col("t_norm")).alias("t_w")))
    rare = F.array(*[F.lit(t) for t in rare_terms(template_terms, least)]).cast("array<string>")
    candidate = lambda c: F.arrays_overlap(terms(F.col(c)), rare)
    found = (
        texts.where(candidate(text)).select(F.col(key).alias("file"), F.explode_outer(pieces(F.col(text))).alias("statement"))
        .where(candidate("statement"))
        .select("file", F.trim("statement").alias("statement"))
        .withColumn("id", F.md5(F.col("statement").cast("binary")))
        .distinct()
    )
    found = cut(found)
    statements = cut(found.groupBy("id").agg(F.first("statement").alias("statement")))
    words = cut(weighted(statements, idf, "id"))
    norm = words.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (
        words.join(F.broadcast(template_terms), "term")  # a row for each term of the templates, which are a parameter
        .groupBy("id", "template", "licence").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    )
    best = (
        dots.join(norm, "id").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least)
        .groupBy("id").agg(F.min(F.struct(-F.col("cosine"), "licence")).alias("b"))
        .select("id", F.col("b.licence").alias("licence"), (-F.col("b.col1")).alias("cosine"))
    )
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = found.select("file", "id", F.pmod(F.xxhash64("file"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["id", "salt"])
    return (
        hits.groupBy("file").agg(F.min(F.struct(-F.col("cosine"), "licence")).alias("b"))
        .select(F.col("file").alias(key), F.col("b.licence").alias("licence"), (-F.col("b.col1")).alias("cosine"))
    )


def folder(path: Column) -> Column:
    """The directory of a path without its last part; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it, the root too."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scanned(files: DataFrame, key: str, path: str, text: str, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """A row per file: ``key``, ``path``, ``own_licence`` with ``cosine``, ``licence`` and ``licence_dir``.

    ``licence`` is the file's own one, else that of the nearest directory at or above it with
    a licence file of known licence (``licence_dir``; several such files in one directory: the
    best cosine, then the first name), else null. Rarities count the rows of all texts. ``key`` names a file: rows with one key and
    different texts share the best notice. A null key or path: no notice, no inheritance. Null
    and empty texts have no notice. Columns of ``files`` other than the three are not read.
    An empty table gives no rows.
    """
    base = files.select(F.col(key).alias("file"), F.col(path).alias("path"), F.col(text).alias("text"))
    own = cut(notices(base.where("file is not null"), "file", "text", templates, least))
    files_own = base.select("file", "path").join(own.withColumnRenamed("licence", "own_licence"), "file", "left")
    directories = (
        files_own.where(F.col("own_licence").isNotNull() & F.col("path").rlike(LICENCE_FILE))
        .groupBy(folder(F.col("path")).alias("licence_dir"))
        .agg(F.min(F.struct(-F.col("cosine"), "own_licence")).alias("b"))
        .select("licence_dir", F.col("b.own_licence").alias("licence"))
    )
    asking = base.where("path is not null").select(folder(F.col("path")).alias("dir")).distinct()
    nearest = (
        asking.select("dir", F.explode(ancestors(F.col("dir"))).alias("licence_dir")).join(directories, "licence_dir")
        .groupBy("dir").agg(F.max_by(F.struct("licence", "licence_dir"), F.length("licence_dir")).alias("n"))
        .select("dir", "n.licence", "n.licence_dir")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    asked = files_own.withColumns({"dir": folder(F.col("path")), "salt": F.pmod(F.xxhash64("file"), F.lit(SALTS)).cast("int")})
    inherits = F.col("own_licence").isNull()
    return asked.join(nearest, ["dir", "salt"], "left").select(
        F.col("file").alias(key), F.col("path").alias(path), "own_licence", "cosine",
        F.coalesce("own_licence", "licence").alias("licence"), F.when(inherits, F.col("licence_dir")).alias("licence_dir"),
    )
