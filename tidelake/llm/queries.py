"""The queries of this package, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .bpe import encode_texts
from .chat import digests, format_conversations
from .filter_audit import audit
from .langid import identify
from .lattice import near_vectors
from .licenses import scan, with_planted
from .lm import score_texts
from .mixing import mix_counts
from .quality import assess
from .segment_bpe import encode_by_ranks
from .simhash import near_duplicates
from .spelling import variants
from .token_counts import count_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False, digests=True)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return digests(format_conversations(rows.unionByName(more)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(_table(spark, sf_dir, "documents")).drop("clean_text")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def licenses_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over documents of which every fiftieth is an entire known text."""
    return scan(with_planted(_table(spark, sf_dir, "documents")))


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, _fold(3) != 1).withColumn("held_out", F.coalesce(_fold(3) == 1, F.lit(False)))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_fold(5) == 1, F.lit(False))
    tune = F.floor(F.crc32(F.col("doc_id").cast("string")) / 5) % 10 == 0
    return score_texts(_table(spark, sf_dir, "documents"), ~held, tune).withColumn("held_out", held)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_table(spark, sf_dir, "documents"))


def op12_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_by_ranks(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False, digests=True)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_counts, op2_bpe, op3_chat, op4_quality, op5_licenses, op6_language, op7_lattice, op8_simhash, op9_lm, op10_mixing, op11_spelling, op12_segment_bpe, op13_filter_audit)
    return {f.__name__: f for f in (*every, licenses_planted)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": sql.quality_sql(), "op5_licenses": sql.licenses_sql(), "op10_mixing": sql.mixing_sql(), "op13_filter_audit": sql.filter_audit_sql(), "licenses_planted": sql.licenses_sql(planted=True)}
