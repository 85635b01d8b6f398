"""Language identification by a bidirectional gated recurrent network over bytes.

A text in lower case is cut into windows of up to WINDOW bytes, at white space
where there is some and between characters where there is none; spaces, digits
and punctuation inside windows are read like letters. The network reads each
window both ways and labels every byte; a document's probabilities are the
mean over its bytes. It is trained in numpy on windows of a bounded sample.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import ship
from .gru import ByteGRU
from .token_counts import slices

#: The sample of each language: documents, and windows of each of them, at most. Languages are not bounded.
TRAIN_DOCS, DOC_WINDOWS = 400, 16
#: Training steps, and how many more for each language.
STEPS, LANG_STEPS, HIDDEN = 400, 10, 12
#: Parts in which a language's sample is drawn first.
SALTS = 8
#: Ids of the sample that are broadcast, at most.
MAX_SENT = 200_000
WINDOW = 48
_SPACE = rb"\x09-\x0d\x20"
_CUT = re.compile(rb"[^%b](?:[\x00-\xff]{0,%d}(?=[%b]|\Z)|[\x00-\xff]{0,%d}(?![\x80-\xbf]))" % (_SPACE, WINDOW - 1, _SPACE, WINDOW - 1))
UNKNOWN = "und"
BATCH_CHARS = 4_000_000
_ASCII = re.compile(r"[A-Za-z]")


def windows(text: str) -> list[bytes]:
    """A text's windows in lower case; no character is cut, and only white space between windows is left out."""
    return _CUT.findall(text.lower().encode("utf-8", "replace"))


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L."""
    return bool(_ASCII.search(text)) or any(map(str.isalpha, text))


def training_windows(docs: DataFrame, lang_col: str, text_col: str, id_col: str, use: Column) -> list[tuple[str, bytes]]:
    """(language, window) from a sample bounded for each language; the same for the same rows.

    Documents are those of the smallest hashes of ids, windows lie evenly in a
    document; those without a byte of a letter or of a character beyond ASCII go.
    """
    ids = docs.where(use & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    ids = ids.withColumn("h", F.xxhash64("id")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for key in (["lang", "salt"], ["lang"]):  # first within parts of a language, so that a common one is no single task
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("h", "id"))
        ids = ids.withColumn("rank", rank).where(F.col("rank") <= TRAIN_DOCS).drop("rank")
    ids = ship.checkpointed(ids.select("id", "lang").distinct())
    few = ids.count() <= MAX_SENT
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(ids) if few else ids, ["id", "lang"], "left_semi").select("lang", "text")

    def cut(batches):
        for b in batches:
            langs, found = [], []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                some = [w for w in windows(text) if re.search(rb"[a-z\x80-\xff]", w)] if has_letter(text) else []
                some = [some[k * len(some) // DOC_WINDOWS] for k in range(DOC_WINDOWS)] if len(some) > DOC_WINDOWS else some
                langs += [lang] * len(some)
                found += some
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    got = rows.mapInArrow(cut, "lang string, window binary").toArrow()  # TRAIN_DOCS * DOC_WINDOWS windows of each language at most
    return sorted(zip(got.column("lang").to_pylist(), got.column("window").to_pylist(), strict=True))


def train(sample: list[tuple[str, bytes]], steps: int = STEPS, hidden: int = HIDDEN) -> tuple[list[str], ByteGRU | None]:
    """Languages and the network; every language weighs the same."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return [], None
    at = {x: i for i, x in enumerate(langs)}
    label = np.array([at[lang] for lang, _ in sample])
    weight = 1 / np.bincount(label, minlength=len(langs))[label]
    model = ByteGRU(len(langs), hidden)
    model.fit([w for _, w in sample], label, weight, steps + LANG_STEPS * len(langs))
    return langs, model


class Labeller:
    """Pools the labels of a document's bytes."""

    def __init__(self, langs: list[str], model: ByteGRU | None):
        self.langs = langs
        self.reader = model.reader() if model else None

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        if self.reader is None:
            return [(UNKNOWN, 0.0)] * len(texts)
        cut = [windows(t) if has_letter(t) else [] for t in texts]
        parts = [w for c in cut for w in c]
        if not parts:
            return [(UNKNOWN, 0.0)] * len(texts)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        raw, begin = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(np.r_[0, size[:-1]])
        sums = np.zeros((len(parts) + 1, len(self.langs)))
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            sums[at + 1] = self.reader(raw[begin[at][:, None] + np.arange(n)])
        end = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        total = np.cumsum(sums, axis=0)
        pooled = total[end] - total[np.r_[0, end[:-1]]]
        best, mass = pooled.argmax(axis=1), pooled.sum(axis=1)
        return [(self.langs[k], float(min(1.0, p[k] / m))) if c else (UNKNOWN, 0.0) for c, k, p, m in zip(cut, best.tolist(), pooled, mass.tolist(), strict=True)]


def identify(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole_rows: bool = False) -> DataFrame:
    """``id_col``, lang_pred, score (mean probability of that language over all bytes) of every whole text.

    With ``whole_rows`` the rows come back as a struct ``row`` in place of the id.

    Learns from the text and non-null language of a sample, bounded for each
    language, of the rows where ``train_on`` holds and the id is not null. Null
    texts and texts without a letter (Unicode category L) are ``und`` with
    score 0, as is every text if nothing can be learned. An empty table gives
    an empty result; repeated rows are each labelled; other columns are not
    looked at.
    """
    spark = docs.sparkSession
    ship.ship(spark)
    model = spark.sparkContext.broadcast(train(training_windows(docs, lang_col, text_col, id_col, train_on)))
    dealt, id_col = (docs.withColumn("row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), "row") if whole_rows else (docs, id_col)

    def run(batches):
        labeller = Labeller(*model.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [x for i, j in slices([len(t) for t in texts], BATCH_CHARS) for x in labeller.label(texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    rows = ship.keyed_text(dealt, id_col, text_col)
    schema = StructType([rows.schema["id"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
