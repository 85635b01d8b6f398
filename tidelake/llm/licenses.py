"""Licence scans by canonical digest lookup, with DataFrame functions only.

A text is brought to one form that doesn't depend on its line breaks: lower
case, no punctuation, one spelling of words that mean the same, without the
titles and copyright statements in front of it, without the holder named in a
filled-in appendix, as one sequence of words. Its digest is looked up among
those of entire known texts, which pass through the same function. Nothing is
taken out of the terms, so one changed word in any clause loses the licence.
Digests of single lines are looked up as well, among those of known notices.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that are taken as the same.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("recognised", "recognized"),
    ("favour", "favor"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("https ", "http "),
]
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
#: Lines in front of a text that may be titles or copyright statements.
FRONT_LINES = 40
# Titles, in canonical form; years and versions are part of them.
TITLE = (
    r"(?:(?:the )?(?:mit|isc|zlib|bsd (?:2|3|zero) clause|(?:2|3|zero) clause bsd|apache|artistic|boost software|mozilla public) license(?: (?:mit|isc))?"
    r"|0bsd|zero clause bsd|(?:the )?unlicense|gnu (?:lesser |library )?general public license|gnu free documentation license|creative commons legal code|cc0 1 0 universal"
    r"|attribution sharealike 4 0 international|http www apache org licenses|version \d(?: \d)?|(?:\d\d?(?:st|nd|rd|th) )?\d{4}"
    r"|(?:\d\d? )?(?:january|february|march|april|may|june|july|august|september|october|november|december)(?: \d\d?(?:st|nd|rd|th))?(?: \d{4})?)"
)
TITLES = rf"^(?:{TITLE}(?: |$))+$"
#: A line that states a copyright, unless it says more than whose.
STATEMENT = r"^(?:portions )?(?:copyright|c)(?: |$)|^all rights reserved$"
TERMS = r"(?:^| )(?:you|may|must|shall|not|no|only|use|permission|permitted|prohibited|granted|licensed|redistribution|redistributions|anyone|this)(?: |$)"
#: Words of a statement that goes on over lines, into the terms.
STEWARD = r"(?:^| )(?:free|everyone)(?: |$)|^(?:copyright|c)(?: c)?(?: \d{4})*$"
#: A statement that is on one line with the terms that follow it.
INLINE = r"^(?:copyright|c)(?: c)?(?: (?:yyyy|year|\d{4}))+((?: [^ ]+){0,20}?) (everyone is permitted to copy|permission is hereby granted|permission to use copy|redistribution and use|this software is provided)"
#: The holder in an appendix that tells how to apply the terms.
APPENDIX = r"copyright(?: c)?(?: (?:yyyy|year|\d{4}))+(?: [^ ]+){0,8}? (licensed under the apache license)"
#: Licences that allow use in training; others are marked.
ALLOWED = ("Apache-2.0", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0")
#: Known digests that are sent to the tasks, at most.
MAX_KNOWN = 10_000
# Licence texts and notices.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_DISCLAIM = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("ISC", f"ISC License\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_DISCLAIM}"),
    ("0BSD", f"Zero-Clause BSD\n{_GRANT}.\n{_DISCLAIM}"),
    (
        "MIT",
        "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]


def lines(text: Column) -> Column:
    """Lines in lower case without punctuation."""
    x = F.replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), F.lit("©"), F.lit(" copyright "))
    return F.transform(F.split(F.regexp_replace(x, PUNCTUATION, " "), "\n"), lambda x: F.trim(x))


def spelled(x: Column) -> Column:
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def canonical(found: Column) -> Column:
    """One sequence of words from lines: without the front, whatever the line breaks."""
    front = lambda x: (x == "") | x.rlike(TITLES) | (x.rlike(STATEMENT) & ~x.rlike(TERMS) & ~x.rlike(STEWARD))
    first = F.array_position(F.transform(F.slice(found, 1, FRONT_LINES), lambda x: ~front(x)), True).cast("int")
    first = F.when(first > 0, first).otherwise(FRONT_LINES + 1)
    return F.array_join(F.filter(F.slice(found, first, F.greatest(F.size(found), F.lit(1))), lambda x: x != ""), " ")


def body(words: Column) -> Column:
    """Canonical words without titles, statements and holders that line breaks don't set apart."""
    x = F.regexp_replace(spelled(words), f"^(?:{TITLE} )+", "")
    x = F.when(x.rlike("^(?:copyright|c) ") & ~F.regexp_extract(x, INLINE, 1).rlike(TERMS), F.regexp_replace(x, INLINE, "$2")).otherwise(x)
    return F.when(F.contains(x, F.lit("licensed under the apache license")), F.regexp_replace(x, APPENDIX, "$1")).otherwise(x)


def whole_digest(words: Column) -> Column:
    return F.when(words != "", F.md5(words.cast("binary")))


def _digested(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, lines and digest of each text."""
    at = rows.select(*keep, lines(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lines"))
    at = at.select(*keep, "lines", canonical(F.col("lines")).alias("words"))
    return at.select(*keep, "lines", whole_digest(body(F.col("words"))).alias("digest"))


def known_digests(known: DataFrame) -> DataFrame:
    """Digest and licence of known texts (license, text): one row per digest, the first licence by name."""
    d = _digested(known.select("license", "text"), "license")
    return d.where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def texts() -> list[tuple[str, str]]:
    """Entire texts from ``license_texts`` (license.txt), each as written, without what follows its terms, and, of the BSD licences, with bullets."""
    out = []
    for f in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if not f.name.endswith(".txt"):
            continue
        name, text = f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")
        forms = [text]
        if end := re.search(r"(?m)^ *END OF TERMS AND CONDITIONS *$", text):
            forms += [text[: end.end()], text[: end.start()]]
        if name.startswith("BSD-"):
            forms += [re.sub(r"(?m)^\d\. ", "* ", text)]
        out += [(name, x) for x in forms]
    return out


#: In front of planted texts.
HOLDER = "Copyright (c) 2024 Someone & Others\nAll rights reserved.\n\n"


def planted() -> list[tuple[str, str]]:
    """Entire texts of up to 8,000 characters, for a query that plants them in documents."""
    return [x for x in KNOWN if "\n" in x[1]] + [x for x in texts() if len(x[1]) <= 8000]


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: every fiftieth text is a known one under a copyright statement, some in upper case with other line ends, some after words of another kind."""
    some = planted()
    round_ = F.floor(F.col("doc_id") / (50 * len(some)))
    text = F.element_at(F.array(*[F.lit(b) for _, b in some]), (F.floor(F.col("doc_id") / 50) % len(some) + 1).cast("int"))
    text = F.when(round_ % 2 == 1, F.upper(F.replace(text, F.lit("\n"), F.lit(" \r\n")))).otherwise(text)
    return docs.select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit(HOLDER), F.when(round_ % 3 == 2, "Some words before it. ").otherwise(""), text)).otherwise(F.col("text")).alias("text"))


def standard(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN + texts(), "license string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED, most: int = MAX_KNOWN) -> DataFrame:
    """One row per document: ``id_col``, digest of the entire text, license (of the entire text), notices (licences of single lines), restricted.

    restricted: a licence or notice that is not in ``allowed``. A null text, one
    without letters, and one of titles and statements only has no digest and no licence. Ids are unique by
    contract; rows that repeat an id each get their own. An empty table gives
    an empty result; other columns are not looked at. Every text is read once.
    Up to ``most`` known digests are sent to the tasks, so that documents are
    not shuffled; more are joined by key, with the same result.
    """
    known = known_digests(standard(docs.sparkSession) if known is None else known)
    few = known.limit(most + 1).collect()
    d = _digested(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    d = d.select("id", "digest", F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.md5(spelled(x).cast("binary"))).alias("lines"))
    if len(few) <= most:
        known = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in few], "digest string, license string"))
        names = F.create_map(*[F.lit(x) for r in few for x in r]) if few else F.create_map().cast("map<string,string>")
        hits = F.filter("lines", lambda x: x.isin([r.digest for r in few]))
        out = d.join(known, "digest", "left").withColumn("notices", F.sort_array(F.array_distinct(F.transform(hits, lambda x: names[x]))))
    else:
        d = d.select(F.xxhash64("id", "digest", "lines").alias("row"), "*")  # rows that repeat an id are told apart
        found = d.select("row", F.explode(F.array_distinct("lines")).alias("digest")).distinct().join(known, "digest")
        notices = found.groupBy("row").agg(F.sort_array(F.collect_set("license")).alias("notices"))  # licences of one document: as many as are known at most
        out = d.join(known, "digest", "left").join(notices, "row", "left").withColumn("notices", F.coalesce("notices", F.array().cast("array<string>")))
    found = F.array_compact(F.array_append("notices", F.col("license")))
    ok = F.array(*[F.lit(a) for a in allowed])
    return out.select(F.col("id").alias(id_col), "digest", "license", F.array_join("notices", ",").alias("notices"), (F.size(F.array_except(found, ok)) > 0).alias("restricted"))
