"""License scans (8): whole texts looked up among known licences by canonical digest.

In Spark expressions only. A text is made canonical: lower case, copyright lines and
everything but letters and digits dropped, equivalent spellings made one, blanks
collapsed. A copyright line has the form of a notice (word or sign, then a year or a
holder); lines of a licence that only begin with the word ('copyright holders') stay. The digest of the canonical text, title lines at its head left out
('MIT License'), is hash-joined to the digests of the known licences: the notices of
``KNOWN`` and the whole texts of ``WHOLE`` (a fixed table, so its broadcast has a fixed
size). The lines of the
text are looked up the same way, which finds the notices by which a document states
its licence. A text that differs in a single word has another digest: this finds
licences, not texts about them.

Defined cases: a null or empty text, or one of copyright lines and signs only, has the
digest of the empty text and no licence; repeated rows are scanned alike; an empty
table gives an empty result; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, without
from .license_texts import BSD_3, TEXTS

# Spellings that count as equal.
SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("catalogue", "catalog"),
    ("centre", "center"), ("favour", "favor"), ("fulfil ", "fulfill "), ("initialise", "initialize"),
    ("non commercial", "noncommercial"), ("non-commercial", "noncommercial"), ("organisation", "organization"),
    ("programme", "program"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("whilst", "while"),
    ("https", "http"), ("&", " and "), ("version 2.0", "version 2"), ("version 3.0", "version 3"),
)

# Texts of known licences and of the notices that state one.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS "
     "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
     "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS "
     "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
     "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
     "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
     "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
     "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
     "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
     "PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Released under the BSD License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Canonical title lines, as licences have them above their text, in any order.
TITLES = (
    "license", "the license", "software license", "all rights reserved", "mit license", "the mit license", "the mit license mit", "mit license mit",
    "mit", "expat license", "isc license", "the isc license", "isc license isc", "the isc license isc", "isc", "zero clause bsd", "bsd zero clause license",
    "zero clause bsd license", "zero clause bsd license 0bsd", "0bsd", "bsd zero clause license 0bsd", "bsd license", "the bsd license", "new bsd license",
    "the new bsd license", "modified bsd license", "simplified bsd license", "bsd 2 clause license", "the bsd 2 clause license", "bsd 2 clause",
    "bsd 2 clause simplified license", "bsd 2 clause simplified", "freebsd license", "bsd 3 clause license", "the bsd 3 clause license", "bsd 3 clause",
    "bsd 3 clause new or revised license", "bsd 3 clause new license", "revised bsd license", "apache license", "the apache license", "version 2 january 2004",
    "apache license version 2 january 2004", "apache license version 2", "apache license 2 0", "http www apache org licenses", "gnu general public license",
    "the gnu general public license gpl", "the gnu general public license", "version 1 february 1989", "version 2 june 1991", "version 3 29 june 2007",
    "gnu general public license version 2 june 1991", "gnu general public license version 3 29 june 2007", "gnu general public license version 3",
    "gnu general public license version 2", "gnu lesser general public license", "version 2 1 february 1999", "gnu library general public license",
    "gnu lesser general public license version 3 29 june 2007", "gnu lesser general public license version 2 1 february 1999", "gnu free documentation license",
    "version 1 2 november 2002", "version 1 3 3 november 2008", "mozilla public license", "mozilla public license version 2 0", "mozilla public license version 2",
    "mozilla public license version 1 1", "version 1 1", "version 2 0", "version 2", "the artistic license", "artistic license", "creative commons legal code",
    "cc0 1 0 universal", "creative commons zero v1 0 universal", "the unlicense", "unlicense", "boost software license version 1 0 august 17th 2003",
    "boost software license version 1 0", "boost software license", "zlib license", "the zlib license", "zlib",
)
TITLE_LINES = 8


def _whole_texts() -> tuple[tuple[str, str], ...]:
    """(id, text) of whole licences in their usual variants: the BSD ones with or without
    numbers, by holder and name; ISC with 'and'; long ones with or without what follows their terms."""
    out = []
    for numbered in (True, False):
        for bsd in (BSD_3, BSD_3.replace("COPYRIGHT HOLDERS AND", "COPYRIGHT HOLDER AND")):
            for owner in ("HOLDER", "HOLDERS", "OWNER"):
                text = bsd.replace("COPYRIGHT\nHOLDER OR", f"COPYRIGHT\n{owner} OR")
                parts = [p[3:] if not numbered and p[:1].isdigit() else p for p in text.split("\n\n")]
                out.append(("BSD-2-Clause", "\n\n".join(p for p in parts if "Neither the name" not in p)))
                for name in ("the copyright holder", "the copyright holders", "the copyright owner", "the author", "the authors", "the project", "the organization", "the University"):
                    for whose in ("its", "their", "any"):
                        out.append(("BSD-3-Clause", "\n\n".join(parts).replace("the copyright holder nor the names of its", f"{name} nor the names of {whose}")))
    for i, text in KNOWN:
        if i in ("ISC", "0BSD") and "modify, and/or distribute" in text:
            out.append((i, text.replace("modify, and/or distribute", "modify, and distribute")))
        if i == "MIT" and "permission notice shall" in text:
            out.append((i, text.replace("permission notice shall", "permission notice (including the next paragraph) shall")))
    for i, text in TEXTS:
        out.append((i, text))
        terms, end, rest = text.partition("END OF TERMS AND CONDITIONS")
        if rest.strip():
            out += [(i, terms + end), (i, terms)]
        if i == "Unlicense":
            out += [(i, text.replace("http:", "https:")), (i, text[:text.index("For more information")])]
            out.append((i, text.replace("http://unlicense.org/", "https://unlicense.org")))
    return tuple(dict.fromkeys(out))


# Whole texts of known licences, for the text as a whole.
WHOLE = _whole_texts()
MOST_KNOWN = 1_000
#: Whole licences that ``planted`` puts into a listing: one text of each id.
PLANTED = tuple(dict((i, (i, t)) for i, t in (*WHOLE, *((i, t) for i, t in KNOWN if "\n" in t)) if len(t) < 20_000).values())

# Words after 'copyright' that name no holder.
NO_HOLDER = (
    r"(?:holder|owner|notice|law|licen[sc]e|statement|interest|permission|disclaimer|act|right|claim|infringement|work|doctrine|material|term|issue|treat(?:y|ie))s?"
    r"|holder['’]s|owner['’]s|ownership|licen[sc]ing|information|protection|protected|resulting|status|policy|like|year"
    r"|and|or|of|on|in|is|are|if|as|to|for|with|under|that|which|may|shall|must|will|can|but|any|this|these|the[ \t]+(?:software|program|library|work|document)"
)
COPYRIGHT_LINE = (
    r"(?md)^[ \t]*(?:"
    r"(?:copyright|\(c\)|©)(?:[ \t:,]|copyright\b|\(c\)|©|by\b)*[\[<{(]?(?:(?:[12][0-9]{3}|19yy|20yy|yyyy)\b|year\b)"  # a year, or the place of one
    r"|copyright[ \t:,]*(?:\(c\)|©)|©"  # the sign
    rf"|copyright(?:[ \t]+|[ \t]*:[ \t]*)(?!(?:{NO_HOLDER})\b|the[ \t]*$)[\p{{L}}\p{{N}}\[<{{]"  # a holder
    r")[^\n]*$"
)
OUTPUTS = ("license_id", "notices", "n_notice_lines", "canonical_md5")


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that have a letter or digit."""
    t = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def untitled(lines: Column) -> Column:
    """Canonical lines without the title lines at their head (``TITLE_LINES`` at most)."""
    other = F.array_position(F.transform(F.slice(lines, 1, TITLE_LINES), lambda x: x.isin(*TITLES)), F.lit(False)).cast("int")
    first = F.when(other > 0, other).otherwise(F.lit(TITLE_LINES + 1))
    return F.when(F.get(lines, F.lit(0)).isin(*TITLES), F.slice(lines, first, F.greatest(F.size(lines), F.lit(1)))).otherwise(lines)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, id) of the known licences without titles; ``MOST_KNOWN`` at most, so it may be broadcast."""
    if len(known) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known licences")
    table = spark.createDataFrame([(i, t) for i, t in known], "id string, text string")
    digest = F.md5(F.array_join(untitled(canonical_lines(F.col("text"))), " ").cast("binary"))
    return table.select(digest.alias("digest"), "id").groupBy("digest").agg(F.min("id").alias("id"))


def scan_licenses(docs: DataFrame, text_col: str = "text", known=KNOWN, whole=WHOLE) -> DataFrame:
    """``docs`` with ``license_id`` (of the licence that the whole text is, else null),
    ``notices`` (sorted ids of the licences that its lines are), ``n_notice_lines`` and
    ``canonical_md5``. No shuffle: both lookups are against the fixed table."""
    digests = known_digests(docs.sparkSession, (*known, *whole))
    # the notices as a literal map, for the lines (at most MOST_KNOWN entries, known before the job)
    entries = known_digests(docs.sparkSession, known).collect()
    lookup = F.create_map(*[F.lit(v) for r in entries for v in (r["digest"], r["id"])])
    rows = docs.select(*[quoted(c) for c in without(docs, OUTPUTS)]).withColumn("__lines", canonical_lines(quoted(text_col)))
    rows = rows.withColumn("canonical_md5", F.md5(F.array_join("__lines", " ").cast("binary")))
    titled = F.get("__lines", F.lit(0)).isin(*TITLES)
    rows = rows.withColumn("__body", F.when(titled, F.md5(F.array_join(untitled(F.col("__lines")), " ").cast("binary"))).otherwise(F.col("canonical_md5")))
    rows = rows.join(F.broadcast(digests.withColumnsRenamed({"digest": "__digest", "id": "license_id"})), F.col("__body") == F.col("__digest"), "left")
    found = F.filter(F.transform("__lines", lambda x: F.try_element_at(lookup, F.md5(x.cast("binary")))), lambda x: x.isNotNull())
    return rows.withColumn("__found", found).withColumn("notices", F.array_sort(F.array_distinct("__found"))) \
        .withColumn("n_notice_lines", F.size("__found").cast("long")).drop("__lines", "__body", "__digest", "__found")


def q_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "license_id", F.array_join("notices", ",").alias("notices"), "n_notice_lines", "canonical_md5")


def planted(docs: DataFrame, every: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which each id divisible by ``every`` has a whole licence as its text, behind a
    copyright line: the ``(id / every) mod n``-th of ``PLANTED``, in capitals where that is odd."""
    number = F.floor(quoted(id_col) / F.lit(every))
    chosen = F.when(quoted(id_col) % every == 0, F.pmod(number, F.lit(len(PLANTED))).cast("int"))
    table = docs.sparkSession.createDataFrame([(i, text) for i, (_, text) in enumerate(PLANTED)], "__n int, __licence string")
    joined = docs.withColumn("__at", chosen).join(F.broadcast(table), F.col("__at") == F.col("__n"), "left")  # a fixed table
    body = F.when(number % 2 == 1, F.upper("__licence")).otherwise(F.col("__licence"))
    text = F.when(F.col("__licence").isNotNull(), F.concat(F.lit("Copyright (c) 2021 The Owners\n\n"), body)).otherwise(quoted(text_col))
    return joined.withColumn(text_col, text).drop("__at", "__n", "__licence")


def q_license_scan_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over documents of which a fifth are whole licences."""
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return scan_licenses(docs).select("doc_id", "license_id", F.array_join("notices", ",").alias("notices"), "n_notice_lines", "canonical_md5")
