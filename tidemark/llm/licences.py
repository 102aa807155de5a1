"""Licence scan by canonical digest lookup, in DataFrame operations alone.

A text is brought to a canonical form (ASCII letters in lower case, lines that name a copyright holder dropped,
punctuation as white space, equivalent spellings made one, white space as single spaces) and its SHA-256 is joined with
the digests of known licence texts. Whole texts match or don't; a licence inside a longer text is not its concern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words after "copyright" that carry on a wrapped sentence instead of naming a holder.
SENTENCE = "notices?|holders?|owners?|owned|licen[sc]es?|laws?|statements?|interests?|protection|acts?|claims?|rights?|information|and|or|in|is|as|of|to|on|for|under|from|with|that|this|shall|may"
#: A line that names a copyright holder: a year, a sign or a name follows "copyright", not the rest of a sentence.
HOLDER_LINE = rf"^[\x20\t]*(?:copyright(?=[^\n]*[a-z0-9©])(?![\x20\t]*(?:{SENTENCE})(?![a-z0-9]))(?![a-z0-9])|\(c\)|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[!-/:-@\[-`{-~‘’“”–—]+"
#: All that stands between words, in one pattern; line breaks one by one, so that every line's start is seen.
BETWEEN = rf"(?md){HOLDER_LINE}|{PUNCTUATION}|[\x20\x09\x0B-\x0D]+|\n"

#: Texts of a caller's own whose digests are sent to all tasks, at most.
MOST_SENT = 100_000

# Equivalent spellings that count as the same word in licence matching.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "sub license": "sublicense",
    "organisation": "organization",
    "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "labour": "labor",
    "merchantibility": "merchantability",
    "modelled": "modeled",
    "noncommercial": "non commercial",
    "per cent": "percent",
    "recognise": "recognize",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "http": "https",
}

# Public licence texts and notices.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (
    ("MIT", f"MIT License\n\n{_MIT_GRANT}"),
    ("MIT", _MIT_GRANT),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_TWO}{_BSD_END}"),
    ("BSD-2-Clause", f"{_BSD_TWO}{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_TWO}{_BSD_NAME}{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_TWO}{_BSD_NAME}{_BSD_END}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
)
# Further notices of one line, which stand in longer texts.
NOTICES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
# Digests, in the canonical form below, of longer licences as their stewards publish them.
DIGESTS = {
    "Apache-2.0": "62c23944e22c7e1579b00eab372c8062d04f03e360aaab08b4030b71d5eac153",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f",
    "GFDL-1.3": "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7",
    "GPL-1.0": "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
    "GPL-2.0": "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",
    "MPL-2.0": "3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text; null is null.

    One pass of a pattern takes the words apart, one lookup a word makes spellings of one word one, and plain
    replacements those of two.
    """
    single = {a: b for a, b in SPELLINGS.items() if " " not in a}
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != "")
    table = F.create_map(*(F.lit(x) for kv in single.items() for x in kv))
    spelt = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    joined = F.concat(F.lit("  "), F.array_join(spelt, "  "), F.lit("  "))
    for a, b in SPELLINGS.items():
        if " " in a:
            joined = F.replace(joined, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
    return F.trim(F.replace(joined, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """digest and license_id of known texts: one row a digest (the smallest id where canonical forms coincide).

    `texts` (license_id, text) adds the caller's own to KNOWN and DIGESTS. A text whose canonical form is empty is left
    out, as nothing matches it.
    """
    own = spark.createDataFrame(KNOWN, "license_id string, text string")
    every = own if texts is None else own.unionByName(texts.select("license_id", "text"))
    made = every.where(F.length(canonical(F.col("text"))) > 0).select(digest(F.col("text")).alias("digest"), "license_id")
    long = spark.createDataFrame([(d, k) for k, d in DIGESTS.items()], "digest string, license_id string")
    return made.unionByName(long).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licences(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id for every row of `docs` (doc_id, text); license_id is null where no known text matches.

    Null texts have a null digest and match nothing; empty ones and such as are all punctuation share the digest of
    the empty string and match nothing; whole texts of any length; repeated rows stay; other columns are ignored; an
    empty table gives no rows. Only whole texts that a digest is known of match: no excerpts, no edited texts.
    The registry is sent to the tasks while it has at most MOST_SENT further texts, so that no row is shuffled; a larger
    one meets the rows by digest.
    """
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    known = known_digests(docs.sparkSession, texts).select(F.col("digest").alias("known"), "license_id")
    if texts is None or texts.select("license_id").limit(MOST_SENT + 1).count() <= MOST_SENT:
        known = F.broadcast(known)
    return rows.join(known, F.col("digest") == F.col("known"), "left").select("doc_id", "digest", "license_id")


def licence_lines(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, line (from 0), license_id for every line of `docs` (doc_id, text) whose digest is that of a known text.

    Notices of one line stand in longer texts; here each line is a text of its own, by the same canonical form, digests
    and join, with NOTICES and the caller's `texts` beside the known ones. Null and empty texts have no such line,
    whole texts of any length are taken apart, repeated rows and lines each count, other columns are ignored.
    """
    spark = docs.sparkSession
    notices = spark.createDataFrame(NOTICES, "license_id string, text string")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    keyed = lines.select(F.struct("doc_id", "line").alias("doc_id"), "text")
    found = scan_licences(keyed, notices if texts is None else notices.unionByName(texts.select("license_id", "text")))
    return found.where("license_id is not null").select("doc_id.doc_id", "doc_id.line", "license_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(lines: bool = False) -> str:
    """The scan, or with `lines` that of every line, in DuckDB's dialect, whose patterns look neither ahead nor back: sentences that begin with "copyright" are set apart first."""

    def form(c: str) -> str:
        out = f"translate({c}, '{UPPER}', '{LOWER}')"
        out = f"regexp_replace({out}, '(^|\\n)([\\x20\\t]*)copyright([\\x20\\t]*({SENTENCE})\\b)', '\\1\\2\x01copyright\\3', 'g')"
        out = f"regexp_replace({out}, '(^|\\n)[\\x20\\t]*(copyright(©|[^a-z0-9\\n][^\\n]*?[a-z0-9©])|\\(c\\)|©|all rights reserved)[^\\n]*', chr(10), 'g')"
        out = f"regexp_replace(replace({out}, '\x01', ''), '{PUNCTUATION}', ' ', 'g')"
        out = f"'  ' || regexp_replace({out}, '[\\x20\\x09-\\x0D]+', '  ', 'g') || '  '"
        for a, b in SPELLINGS.items():
            out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"

    values = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in (*KNOWN, *NOTICES * lines))
    rows = "SELECT doc_id, line, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)"
    long = ", ".join(f"({_quoted(d)}, {_quoted(k)})" for k, d in DIGESTS.items())
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT sha256({form("text")}) AS digest, license_id FROM (VALUES {values}) AS v(license_id, text) WHERE length({form("text")}) > 0
    UNION ALL SELECT * FROM (VALUES {long}) AS w(digest, license_id)
  ) GROUP BY 1
), rows_ AS ({f"SELECT doc_id, CAST(line AS INTEGER) AS line, sha256({form('text')}) AS digest FROM ({rows})" if lines else f"SELECT doc_id, sha256({form('text')}) AS digest FROM documents"})
{"SELECT r.doc_id, r.line, k.license_id FROM rows_ r JOIN known k ON r.digest = k.digest" if lines else "SELECT r.doc_id, r.digest, k.license_id FROM rows_ r LEFT JOIN known k ON r.digest = k.digest"}
"""
