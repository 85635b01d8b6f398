"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage works on all that the one before it kept. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import bpe, langid, mixing, quality, ship, simhash

#: A document's language must have at least this mean probability.
MIN_LANGUAGE = 0.35


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: lines that fail go, and documents that are rejected; n_chars follows the text.

    Null, empty and blank texts are rejected. Repeated rows are each judged;
    null ids and other nulls stay as they are; texts of any length are judged
    whole; columns may have any names.
    """
    judged = quality.assess(docs.withColumn("row", F.struct(*[F.col(c) for c in docs.columns])), "row").where("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents without a language, or with one that is hardly likely, go.

    Null texts and texts without a letter go. Rows with a null id or language
    are judged but not learned from; with nothing to learn from all go. Repeated
    rows are each judged; columns may have any names.
    """
    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    found = langid.identify(docs, train, whole_rows=True)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: of each class one row stays, that of the smallest id (null ids last).

    Null and empty texts are one class; of rows that repeat one stays.
    """
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Temperature mixing: documents as often as the mix of sources takes them.

    A null source is a source of its own; a source without words is not taken.
    Rows that repeat an id, or have none, are taken equally often; columns may
    have any names.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with their digests. Null and empty texts have none; every row is encoded."""
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)


STAGES = [("quality rules", clean), ("language", known_language), ("near duplicates", one_of_each), ("mixing", mixed), ("bpe encoding", encode)]
#: SQL can't express language identification or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to a shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs, path = ship.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last:
            ship.removed(spark, last)
        last = path
    return docs
