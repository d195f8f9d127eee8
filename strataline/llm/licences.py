"""Licence scans by canonical digests.

A text is brought to a canonical form (lower case, copyright notices dropped, one spelling per word, punctuation and
white space as one space) and its digest is joined with the digests of known licence texts.  A text matches only as a
whole; a document is looked up entire, and so is each of its lines, since short licence notices stand on lines of
their own.  Everything here is DataFrame work inside the JVM.

Defined results: null and blank texts have no digest and match nothing; equal rows match alike; of several known names
with one canonical form the first in order is given; an empty table gives no rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import row_digest, settle

# fixed values: spellings that licence texts use for one and the same word
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("favour", "favor"), ("fulfil ", "fulfill "), ("merchantibility", "merchantability"),
    ("whilst", "while"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https ", "http "),
]

# fixed values: short licence notices and short licence texts, as published
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
             "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
             "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
             "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
             "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
            "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
            "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]

TEXTS = Path(__file__).with_name("licence_texts")   # NAME.txt or NAME.VARIANT.txt: whole licences as published, short ones without title and notice
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License", "The BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
}
APPENDICES = [("END OF TERMS AND CONDITIONS", True), ("Exhibit A - Source Code Form License Notice", False), ("EXHIBIT A -Mozilla Public License.", False)]

# notices only, not lines of a sentence on copyright notices or holders, nor list items (c)
COPYRIGHT_LINE = (r"(?m)^[ \t]*(?:copyright[ \t:,]*(?:\(c\)|©|by\b|[\[<{]?(?:[0-9]{4}|yyyy|year))|©|\(c\)[ \t]*copyright\b"
                  r"|(?:copyright(?![ \t]+(?:notice|holder|owner|law|licen))|\(c\))(?=[^\n]*\b(?:19|20)[0-9]{2}\b))[^\n]*$")
NOT_WORDS = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """A text in canonical form, its line breaks kept."""
    c = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), NOT_WORDS, " ")
    for other, one in SPELLINGS:
        c = F.replace(c, F.lit(other), F.lit(one))
    return c


def whole(canonical: Column) -> Column:
    """One line of canonical text; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(canonical, "[ \n]+", " ")), F.lit(""))


def published() -> list[tuple[str, str]]:
    """name, text of whole licences in their usual variants: with and without appendix, title and reservation of rights."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem.removesuffix(".University"), path.read_text(encoding="utf-8")
        out.append((name, text))
        for mark, kept in APPENDICES:
            if mark in text:
                head = text[:text.rindex(mark)]
                out += [(name, head)] + [(name, head + mark)] * kept
    short = [(n, t) for n, t in [*out, *KNOWN] if n in TITLES and len(t) > 200]
    return out + [(n, "\n".join([title, rights, t])) for n, t in short for title in ["", *TITLES[n]] for rights in ("", "All rights reserved.")]


def known_table(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """name, text of the known licences: the short notices and the published texts if none are given."""
    return spark.createDataFrame(KNOWN + published() if known is None else known, "name string, text string")


def digests(known: DataFrame) -> DataFrame:
    """digest, licence of a table of known texts; one name per digest."""
    d = known.select(F.md5(whole(canonical_lines(F.col("text"))).cast("binary")).alias("digest"), F.col("name"))
    return d.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("name").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document: doc_id, digest (canonical, whole text), licence (of the whole text, else null), n_notices (lines
    that are a known text) and notices (their names, sorted, joined by commas)."""
    lines = docs.select("doc_id", row_digest("text").alias("__row"), canonical_lines(F.col("text")).alias("__c"))
    rows = settle(lines.select("doc_id", "__row", F.md5(whole(F.col("__c")).cast("binary")).alias("digest"),
                               F.transform(F.filter(F.transform(F.split("__c", "\n", -1), lambda x: F.trim(x)), lambda x: x != ""),
                                           lambda x: F.md5(x.cast("binary"))).alias("__lines")))
    found = digests(known)
    # equal texts are looked up once
    once = rows.groupBy("__row").agg(F.first("digest", True).alias("digest"), F.first("__lines").alias("__lines"))
    in_text = once.select("__row", "digest").join(found, "digest").select("__row", "licence")
    in_lines = (once.select("__row", F.explode("__lines").alias("digest")).join(found, "digest").groupBy("__row")
                .agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices")))
    hits = in_text.join(in_lines, "__row", "full")
    return rows.join(hits, "__row", "left").select("doc_id", "digest", "licence", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
                                                   F.coalesce("notices", F.lit("")).alias("notices"))
