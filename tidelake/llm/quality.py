"""Line-first cleaning with DataFrame functions only.

Every line is judged by punctuation, navigation, boilerplate and repetition
rules; lines that fail are removed; a document that loses too much of its text
is rejected, as is one that fails the base rules. All work is inside the row:
no shuffle, whatever the sizes.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"""[.!?…:;"”)][\x20\x09-\x0D]*$"""
# Phrases of page furniture, matched without regard to case.
BOILERPLATE = [
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "uses cookies",
    "enable javascript",
    "javascript is disabled",
    "javascript is required",
    "click here",
    "read more",
    "sign in to",
    "sign up for",
    "log in to",
    "subscribe to our",
    "share this",
    "skip to content",
    "skip to main content",
    "back to top",
    "lorem ipsum",
]
#: Words of a navigation line at most, if it ends no sentence.
NAV_WORDS = 2
#: A document is rejected when more than this percentage of its word characters is on failed lines.
MAX_LOST = 40
#: Bars, and quotation marks, whose closing ones are bars where they outnumber the opening ones.
PLAIN_BARS, QUOTES = "|>·•", ("«»", "‹›")
#: A navigation line has a bar in so many words, a notice line a word of a phrase.
BAR_SHARE, NOTICE_SHARE = 10, 8
#: Lines of FEW_WORDS to MANY_WORDS repeat by distinct words, longer ones by the share of windows that came before.
FEW_WORDS, MANY_WORDS, MAX_AGAIN = 8, 40, 0.5
#: Base rules.
MIN_WORDS, MAX_REPEAT = 10, 20
WINDOW = 5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _count(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _phrase_words(low: Column) -> Column:
    """Words of the line that belong to boilerplate phrases."""
    found = [F.when(F.contains(low, F.lit(p)), (F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p) * len(p.split())).otherwise(0) for p in BOILERPLATE]
    return functools.reduce(lambda a, b: a + b, found)


def _again(words: Column) -> Column:
    """Windows of the line that were in it before, as a share of all its windows (of at least WINDOW words)."""
    m = F.size(words) - (WINDOW - 1)
    windows = functools.reduce(_pairs, [F.slice(words, k, m) for k in range(1, WINDOW + 1)])
    return 1 - F.size(F.array_distinct(windows)) / m


def _counts(x: Column) -> Column:
    """What the verdict on a line is made of, each computed once; x: line, w (its words), marks, low (in lower case)."""
    n = F.size(x.w)
    arrows = [F.greatest(_count(x.marks, b) - _count(x.marks, a), F.lit(0)) for a, b in QUOTES]
    plain = functools.reduce(lambda a, b: a + b, arrows, _count(x.marks, PLAIN_BARS))
    marked = x.marks != ""
    return F.struct(
        x.line.alias("line"),
        n.alias("n"),
        F.length(F.array_join(x.w, "")).alias("c"),
        F.when(marked, _count(x.marks, SYMBOLS)).otherwise(0).alias("s"),
        F.when(marked, _count(x.marks, "!")).otherwise(0).alias("bangs"),
        F.when(marked, plain).otherwise(0).alias("bars"),
        F.when(n <= MANY_WORDS, F.when(n >= FEW_WORDS, F.size(F.array_distinct(x.w)) * 2 <= n).otherwise(False)).otherwise(_again(x.w) > MAX_AGAIN).alias("repeated"),
        (_phrase_words(x.low) * NOTICE_SHARE >= n).alias("boiler"),
    )


def _verdict(x: Column) -> Column:
    """The line with its figures and verdicts: bad, notice (bad for its phrases only).

    All rules are shares of the line's words, so a line doesn't fail for being
    long. Quotation marks in pairs are no bars, and one symbol is no table.
    """
    punctuation = ((x.s >= 2) & (x.s * 10 > x.n)) | ((x.bangs >= 3) & (x.bangs * 4 > x.n))
    navigation = ((x.bars >= 2) & (x.bars * BAR_SHARE >= x.n)) | ((x.n <= NAV_WORDS) & ~x.line.rlike(SENTENCE_END))
    other = punctuation | navigation | x.repeated
    return F.struct(x.line.alias("line"), x.n.alias("n"), x.c.alias("c"), x.s.alias("s"), (other | x.boiler).alias("bad"), (x.boiler & ~other).alias("notice"))


def _pairs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """Quality figures and verdicts of every whole text, with its cleaned text.

    Columns: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (words in windows of five words found twice or more),
    base_failed, kept, lost_chars, clean_text (failed lines removed). A null
    text has no words: all counts 0, base_failed, not kept, clean_text null.
    Empty tables give empty results, repeated rows are each judged, other
    columns are not looked at. Windows are compared by 64-bit hashes of a
    single text's windows. A single notice line does not reject a document
    whose other lines have MIN_WORDS words.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("raw"))
    d = d.withColumn("text", F.coalesce("raw", F.lit("")))
    marks = f"[^{SYMBOLS}!{PLAIN_BARS}{''.join(a + b for a, b in QUOTES)}]+"
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), _words(x).alias("w"), F.regexp_replace(x, marks, "").alias("marks"), F.lower(x).alias("low")))
    d = d.select("id", "raw", F.filter(lines, lambda x: F.size(x.w) > 0).alias("lines"))
    d = d.select("id", "raw", F.flatten(F.col("lines.w")).alias("words"), F.transform("lines", _counts).alias("counts"))
    d = d.select("id", "raw", F.transform("counts", _verdict).alias("judged"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    n = F.size("h")
    m = F.greatest(n - (WINDOW - 1), F.lit(0))
    d = d.select("*", _pairs(F.slice("h", 1, F.greatest(n - 1, F.lit(0))), F.slice("h", 2, F.greatest(n - 1, F.lit(0)))).alias("h2"))
    d = d.select("*", _pairs(F.slice("h2", 1, F.greatest(n - 3, F.lit(0))), F.slice("h2", 3, F.greatest(n - 3, F.lit(0)))).alias("h4")).drop("h2")
    d = d.select("id", "raw", "judged", n.alias("n"), _pairs(F.slice("h4", 1, m), F.slice("h", WINDOW, m)).alias("win"))
    # only texts with a repeated window get their windows sorted by hash and place
    some = F.size("win") > F.size(F.array_distinct("win"))
    ordered = F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.select("*", F.when(some, ordered).alias("s")).drop("win")
    again = F.filter("s", lambda v, j: (v.x == F.get(F.col("s"), j - 1).x) | (v.x == F.get(F.col("s"), j + 1).x))
    d = d.select("*", F.sort_array(F.transform(again, lambda v: v.i)).alias("p")).drop("s")
    covered = F.aggregate(F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0), lambda t, x: t + x)
    total = lambda field: F.aggregate("judged", F.lit(0).cast("long"), lambda t, x: t + field(x))
    d = d.select(
        "id",
        "raw",
        "judged",
        F.col("n").cast("long").alias("n_words"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        total(lambda x: x.c).alias("word_chars"),
        total(lambda x: x.s).alias("n_symbols"),
        total(lambda x: F.when(x.bad, x.c).otherwise(0)).alias("lost_chars"),
        (F.size("judged") - F.size(F.array_distinct("judged.line"))).cast("long").alias("n_dup_lines"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT))
    gone = F.filter("judged", lambda x: x.bad)
    rest = F.aggregate("judged", F.lit(0), lambda t, x: t + F.when(x.bad, 0).otherwise(x.n))
    one_notice = (F.size(gone) == 1) & F.exists(gone, lambda x: x.notice) & (rest >= MIN_WORDS)
    kept = ~F.col("base_failed") & ((F.col("lost_chars") * 100 <= F.col("word_chars") * max_lost) | one_notice)
    # a partition number is not deterministic: without it a filter on the verdict would be pushed below all
    # steps, each of which would be written out in it again and again
    kept = kept & (F.spark_partition_id() >= 0)
    clean = F.when(F.col("raw").isNotNull(), F.array_join(F.transform(F.filter("judged", lambda x: ~x.bad), lambda x: x.line), "\n"))
    return d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lost_chars", clean.alias("clean_text"))
