"""License scans by canonical digest lookup.

Method.  A text is normalised: copyright notices dropped (their lines with or without a year, the lines that go on with
them, and "All rights reserved"), lower case, equivalent spellings unified, punctuation and spacing reduced to single blanks.  The SHA-256 of the result is hash-joined with the digests of known licences and
licence notices; a match is the entire text, never a part of it.  The units looked up are the whole document, its
paragraphs and its lines, since notices stand in documents as whole lines.

Scale.  One pass of built-in expressions.  Units' digests are exploded, a row each, and hash-joined with those of the
known texts (``TEXTS``, a fixed table, so its broadcast has a size that does not depend on the corpus); a document's
rows are put together again by its row's number, digests and licences only.  Units that hold no word of a known text,
or are shorter than all of them, are dropped before they are normalised; this loses none, as ``needed`` takes only words
that normalising leaves as they are, and normalising never makes a text longer.  A unit's length is not bounded from
above, since copyright lines, punctuation and blanks of any length are removed.

Defined cases.  A null or empty text matches nothing and has the digest of the empty string.  Repeated rows, and
rows of a null id, each get a row.  A text known under two identifiers counts as the least.  An empty table gives an empty result.  Names of extra columns do not matter.  Very long texts are split whole.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equivalent spellings: pattern, replacement.  Fixed values.
SPELLINGS = (
    (r"licence", "license"), (r"sub-license", "sublicense"), (r"acknowledgement", "acknowledgment"), (r"analogue", "analog"),
    (r"authorise", "authorize"), (r"favour", "favor"), (r"organisation", "organization"), (r"whilst", "while"), (r"non-commercial", "noncommercial"),
    (r"https://", "http://"), (r"per cent", "percent"),
)

#: Known licences and notices: identifier, text.  Fixed values.
KNOWN = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
)

#: Whole licence texts, one file each, named by identifier; some are also known under their titles.
TITLES = (("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("Zlib", "zlib License"), ("ISC", "ISC License"))
FULL = tuple((f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))
FULL += tuple((name, f"{title}\n\n{text}") for name, title in TITLES for known, text in KNOWN + FULL if known == name and len(text) > 200)
TEXTS = KNOWN + FULL


#: A line of a copyright notice, after marks of a comment: the sign or the word with a year or a name.  The word before what
#: licences say of it ("copyright holder", "copyright license") begins a line of their texts, and so does "(c)" as a number.
_MARKS = r"[^\p{L}\p{N}\n(©<]*"
_SIGN = r"(?:\([cC]\)|©|&copy;)"
_OWN = r"(?!(?:[Hh]older|[Oo]wner|[Ll]icen[sc]e|[Nn]otice|[Ll]aws?|[Aa]ct|[Ss]tatement|[Ii]nterest|[Rr]ight|[Aa]nd|[Oo]r|[Ii]n|[Ii]s)\b)"
_NOTICE = rf"(?:(?:SPDX-FileCopyrightText:?\s*)?(?i:copyright)\b[\x20\t:,]*(?:{_SIGN}|[0-9]{{4}})|SPDX-FileCopyrightText:|(?i:copyright)[\x20\t]+[<\[{{]|Copyright[\x20\t]+(?:[Bb]y[\x20\t]+)?{_OWN}[\p{{Lu}}<\[{{\"'(]|{_SIGN}[\x20\t]*(?:(?i:copyright)[\x20\t]*)?[0-9]{{4}})[^\n]*"
_RESERVED = r"(?i:all[\x20\t]+rights[\x20\t]+reserved)[^\p{L}\p{N}\n]*"
#: What goes on with a notice: a year, another sign, "and", what is indented further, rights reserved; after a comma, a year or a sign at a line's end whatever comes.
_MORE = rf"\n(?:{_MARKS}(?:[0-9]{{4}}\b[^\n]*|{_SIGN}[^\n]*|(?:and|And|&)[\x20\t][^\n]*|{_RESERVED})|\k<in>(?:\x20{{4}}|\t)[\x20\t]*\p{{Lu}}[^\n]*)"
_AFTER = rf"(?<=[,&]|\b[0-9]{{4}}|\([cC]\)|©|\band)[\x20\t]*\n(?![^\p{{L}}\p{{N}}\n]*\n)[^\n]+"
NOTICE = rf"(?m)^(?<in>{_MARKS}){_NOTICE}(?:{_AFTER}|{_MORE})*$|^{_MARKS}{_RESERVED}$"


def canonical(text: Column) -> Column:
    """The normal form that is digested: notices go first, while lines and capitals can still be told apart."""
    out = F.lower(F.regexp_replace(text, NOTICE, " "))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark, texts: tuple[tuple[str, str], ...] = TEXTS) -> DataFrame:
    """license, digest: one row for each distinct canonical text."""
    table = spark.createDataFrame(list(texts), "license string, known string")
    return table.select("license", digest(F.col("known")).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def needed(canonicals: list[str]) -> str:
    """A pattern that a lower-case text matches if its canonical form is one of these."""
    words = set()
    for text in canonicals:
        # a word without any replacement in it stands in the text as it is; "license" is spelled in two ways
        plain = [w for w in text.split() if w.isascii() and not any(to.removesuffix("://") in w for _, to in SPELLINGS)]
        words.add("licen[sc]e" if "license" in text else max(plain, key=len, default=""))
    return "" if "" in words else "|".join(sorted(words))


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", texts: tuple[tuple[str, str], ...] = TEXTS) -> DataFrame:
    """A row per row of docs: doc_id, doc_digest, doc_license, licenses (sorted, distinct), n_units (matching units)."""
    table = F.broadcast(known(docs.sparkSession, texts))  # a row for each known text
    forms = [r.form for r in docs.sparkSession.createDataFrame(list(texts), "license string, known string").select(canonical(F.col("known")).alias("form")).collect()]
    pattern, shortest = needed(forms), min(map(len, forms))
    likely = lambda unit: (F.length(unit) >= shortest) & F.lower(unit).rlike(pattern)
    parts = lambda units: F.transform(F.filter(units, likely), digest)
    own = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("content"))
    units = F.concat(parts(F.split("content", "\n")), parts(F.filter(F.split("content", r"\n[\x20\t]*\n\s*"), lambda p: p.contains("\n"))))
    rows = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(F.col("content")).alias("doc_digest"), units.alias("units"))
    each = rows.select("row", "doc_id", "doc_digest", F.explode(F.array_append("units", F.lit(None).cast("string"))).alias("unit"))  # the null stands for the document
    each = each.select("row", "doc_id", "doc_digest", F.col("unit").isNull().alias("whole"), F.coalesce("unit", "doc_digest").alias("digest")).join(table, "digest", "left")
    of = lambda part: F.when(part & F.col("license").isNotNull(), F.col("license"))
    found = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("doc_digest").alias("doc_digest"), F.max(of(F.col("whole"))).alias("doc_license"), F.array_sort(F.collect_set("license")).alias("licenses"), F.count(of(~F.col("whole"))).alias("n_units"))
    return found.drop("row")


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    return found.withColumn("licenses", F.array_join("licenses", ","))
