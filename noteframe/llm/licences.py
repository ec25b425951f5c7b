"""Licence texts found by the digest of their canonical form.

A text is brought to one canonical form: ASCII case, punctuation, white space, copyright lines, and
spellings that mean the same. The digest of the whole text and of each of its lines is then
hash-joined to the digests of known licence texts, so a licence is found however it is
wrapped or punctuated, and nothing is compared text by text.

Defined results: a null or blank text matches nothing; a repeated row repeats its matches;
rows without ``doc_id`` match like others; other columns are ignored. The list of known texts
is a parameter; two known texts with one canonical form give one match, of the smaller name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.llm.native import bind

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A line that only says who owns a text: a copyright mark and a year.
COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright|\(c\)|©) *(\(c\)|©)? *([0-9]{4}|<year>|\[year\]|\[yyyy\])"

# (pattern, replacement) on lower-case lines, in order. Both regex dialects read them alike.
SPELLINGS = [
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-commercial", "noncommercial"),
    (r"https?://(www[.])?", ""),
    (r"\(c\)|©", " copyright "),
    (r"&", " and "),
    (r"(version|ver[.]?|v[.]?) *([0-9])", " {2}"),
    (r"([0-9])[.]([0-9])", "{1}_{2}"),
    (r"[\x00-/:-@\[-^`{-\x7f“”‘’–—]+", " "),
    (r"([0-9])_0( |$)", "{1}{2}"),
    (r" +", " "),
]

# Texts and notices of public licences.
KNOWN = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated'
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or"
        ' substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,'
        " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
        " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE"
        ' SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
        " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
        " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released under CC0 1.0."],
    "proprietary": ["All rights reserved."],
}


def canonical_line(line: Column) -> Column:
    """The canonical form of one line; empty for a copyright line."""
    low = F.translate(line, UPPER, LOWER)
    clean = low
    for pattern, new in SPELLINGS:
        clean = F.regexp_replace(clean, pattern, new.replace("{1}", "$1").replace("{2}", "$2"))
    return F.when(low.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(F.trim(clean))


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, empty ones included so that line numbers hold."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), canonical_line)


def _digests(lines: Column) -> Column:
    """Digest of the whole text (line 0) and of each line; nothing for blank ones."""

    def entry(number: Column, text: Column) -> Column:
        return F.struct(number.cast("int").alias("line"), F.when(text != "", F.sha2(text, 256)).alias("digest"))

    whole = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    each = F.transform(lines, lambda x, i: entry(i + 1, x))
    return F.filter(F.concat(F.array(entry(F.lit(0), whole)), each), lambda d: d["digest"].isNotNull())


def known_digests(spark: SparkSession, known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """``digest, license_id`` of the known texts."""
    rows = [F.struct(F.lit(n).alias("license_id"), F.lit(t).alias("text")) for n, texts in known.items() for t in texts]
    whole = spark.range(1).select(F.inline(F.array(*rows)))
    digest = bind(canonical_lines(F.col("text")), _digests)[0]["digest"]
    return whole.groupBy(digest.alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per match: ``doc_id, line, license_id, digest``; line 0 is the whole text."""
    known = known_digests(docs.sparkSession) if known is None else known
    found = docs.select("doc_id", F.explode(bind(canonical_lines(F.col("text")), _digests)).alias("d"))
    found = found.select("doc_id", "d.line", "d.digest")
    return found.join(known, "digest").select("doc_id", "line", "license_id", "digest")
