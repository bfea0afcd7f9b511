"""License scans: digests of canonical texts, hash-joined with those of known licences.

Canonical form: lower case; lines that state a copyright are left out; every
character but letters and digits is dropped; equivalent spellings are unified.
A text's units are the whole text, without a title line before it, and each of
its lines; a unit is a licence
when its digest (SHA-256 of the canonical form) is that of a known text.  All
work is DataFrame functions; the known table is a list given by the caller and
Spark broadcasts it if it is small.

Cases: a null or empty text, and one without any letter or digit, has no
licence; an empty known table finds nothing; repeated rows and ids stay rows of
their own; of two known texts with one canonical form the smaller id counts;
input columns named like an output column give way.
"""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.texts import free_name, others

# Spellings that licence texts use for one another.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"), ("copyright holder", "copyright owner"),
    ("favour", "favor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"), ("percent", "per cent"), ("https:", "http:"), ("&", "and"),
)
# Known licences and notices (id, text); the whole texts of others are in ``TEXTS``.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
)
TEXTS = "license_texts_v1.jsonl"
# A line states a copyright if a mark, a year or a name follows the word; these words go on in a sentence.
_PROSE = (r"(?:owners?|holders?|notices?|laws?|licenses?|statements?|interests?|treat(?:y|ies)|disclaimers?|permissions?|"
          r"protection|and|or|in|of|to|is|are|on|for|that|which|as|if|the (?:software|library|program|work|document))\b")
_COPYRIGHT = (r"(^|\n)[^\p{L}\p{N}\n©]*(?:©|\(c\)[ \t]*(?:copyright\b|[0-9]{4})|copyright\b[ \t:]*(?:©|\(c\)|"
              r"(?![^\p{L}\p{N}\n]*" + _PROSE + r")[^\n]*[\p{L}\p{N}])|all rights reserved[^\p{L}\p{N}\n]*(?=\n|$))[^\n]*")
_TITLE = (r"^\n*(?:(?:the)?(?:mit|isc|(?:new|revised|modified|simplified)?bsd(?:[234]clause)?|[234]clausebsd|apache)"
          r"(?:open source|opensource)?license(?:mit|isc|bsd[234]clause|apache20)?)(?=\n)")


def canonical(text) -> Column:
    """Canonical form, lines kept apart by single line breaks."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.replace(out, F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(out, _COPYRIGHT, "\n"), r"[^\p{L}\p{N}\n]+", "")


def whole_texts() -> list[tuple[str, str]]:
    """(id, text) of the versioned table of licence texts that comes with the package."""
    lines = resources.files("netloom.llm").joinpath(TEXTS).read_text("utf-8").splitlines()
    return [(x["license_id"], x["text"]) for x in map(json.loads, lines)]


def _whole(canon) -> Column:
    """The text as one unit; a spelling of two words may have had a line break in it."""
    joined = F.replace(F.regexp_replace(canon, _TITLE, ""), F.lit("\n"), F.lit(""))
    return F.replace(joined, F.lit("copyrightholder"), F.lit("copyrightowner"))


def known_table(spark, known=None) -> DataFrame:
    """license_id and digest of each known text, read as one unit; by default of all that come with the package."""
    known = [*KNOWN, *whole_texts()] if known is None else known
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    return (rows.select("license_id", _whole(canonical(F.col("text"))).alias("unit")).where("unit <> ''")
            .groupBy(F.sha2("unit", 256).alias("digest")).agg(F.min("license_id").alias("license_id")))


def scan_licenses(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Adds license_id (of the whole text), notices (sorted ids of its lines) and n_notices (such lines)."""
    out = ["license_id", "notices", "n_notices"]
    row, units = free_name(docs, "row"), free_name(docs, "units")
    keep = others(docs, *out, text)
    numbered = docs.select("*", F.monotonically_increasing_id().alias(row))
    canon = canonical(F.col(text))
    lines = F.split(canon, "\n")
    whole = F.struct(F.lit(True).alias("whole"), _whole(canon).alias("unit"))
    cut = numbered.select(*keep, row, F.concat(F.array(whole), F.transform(
        lines, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit")))).alias(units))
    unit = F.col(units)
    each = cut.select(*keep, row, F.explode(F.filter(
        unit, lambda u: (u["unit"] != "") | u["whole"])).alias(units))
    found = each.select(*keep, row, unit["whole"].alias(units), F.sha2(unit["unit"], 256).alias("digest_of_unit")).join(
        known.select(F.col("digest").alias("digest_of_unit"), F.col("license_id").alias("found_license")),
        "digest_of_unit", "left")
    hit = F.col("found_license").isNotNull()
    line, is_whole = ~F.col(units), F.col(units)
    return found.groupBy(*keep, row).agg(
        F.min(F.when(is_whole, F.col("found_license"))).alias("license_id"),
        F.array_join(F.sort_array(F.collect_set(F.when(line, F.col("found_license")))), ",").alias("notices"),
        F.count(F.when(line & hit, 1)).alias("n_notices")).drop(row)
