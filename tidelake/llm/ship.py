"""What the Python-side operators of this package share: shipping code and small files, column checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.package import send

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of input for each bucket of a table.
BUCKET_BYTES = 128 << 20
#: Largest file that may be broadcast: vocabularies and models, never rows.
MAX_BROADCAST_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    send(spark)


def broadcast_file(spark: SparkSession, path: str):
    """A small file's bytes as a broadcast variable; refuses files above MAX_BROADCAST_BYTES."""
    data = Path(path).read_bytes()
    if len(data) > MAX_BROADCAST_BYTES:
        raise ValueError(f"{path}: {len(data)} bytes are too many to broadcast")
    return spark.sparkContext.broadcast(data)


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator on texts needs, under names of its own; null text is empty."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names; only a local session (one machine) may get one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidelake_ck_"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    return f"{checkpoint_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The rows as compressed Parquet in a shared folder, read again, and the folder.

    The shuffle files of the plan go as soon as all rows are written, the folder
    with the application if nobody removes it before.
    """
    path, conf = shared_folder(df.sparkSession, what), df.sparkSession.conf
    before = conf.get(_CLEAN_UP, None)
    conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    finally:
        conf.set(_CLEAN_UP, before) if before is not None else conf.unset(_CLEAN_UP)
    fs, p = _file_system(df.sparkSession, path)
    fs.deleteOnExit(p)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored_bytes(df: DataFrame) -> int:
    """Bytes of what a plan reads, as its statistics say; 0 where they say nothing."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


class Bucketed:
    """Rows written as a table in a shared folder, bucketed by a key: groupings by the key find them in place, without a shuffle.

    There is a bucket for each BUCKET_BYTES of ``source``, and as many as shuffles have partitions at least.
    """

    def __init__(self, df: DataFrame, what: str, key: str, source: DataFrame):
        self.spark, self.path = df.sparkSession, shared_folder(df.sparkSession, what)
        self.name = f"tidelake_{uuid.uuid4().hex}"
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(source) // BUCKET_BYTES))
        df.write.format("parquet").option("compression", "zstd").option("parquet.block.size", 16 << 20).option("path", self.path).bucketBy(n, key).saveAsTable(self.name)
        fs, p = _file_system(self.spark, self.path)
        fs.deleteOnExit(p)
        self.rows = self.spark.table(self.name)

    def remove(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        removed(self.spark, self.path)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)
