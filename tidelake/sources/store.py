"""Named tables as Parquet, CSV or JSON in a folder that Spark reaches, with a cache-or-build catalog."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share, beside the checkpoints; only a local session may get one of its own."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    base = base or tempfile.mkdtemp(prefix="tidelake_")
    return f"{base}/{what}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


class Store:
    """Tables by name and sub-folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, sub: str = "", kind: str = "parquet") -> str:
        return f"{self.root}/{sub + '/' if sub else ''}{name}.{kind}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str, sub: str = "") -> bool:
        fs, p = self._fs(self.path(name, sub))
        return fs.exists(p)

    def names(self, sub: str = "") -> list[str]:
        fs, p = self._fs(f"{self.root}/{sub}")
        return sorted(x.getPath().getName().removesuffix(".parquet") for x in fs.listStatus(p) if x.getPath().getName().endswith(".parquet")) if fs.exists(p) else []

    def save(self, df: DataFrame, name: str, sub: str = "", by: list[str] | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(self.path(name, sub))

    def load(self, name: str, sub: str = "") -> DataFrame | None:
        return self.spark.read.parquet(self.path(name, sub)) if self.exists(name, sub) else None

    def latest(self, name: str, sub: str = "", t: str = "t"):
        df = self.load(name, sub)
        return None if df is None else df.agg(F.max(t)).first()[0]

    def cached(self, name: str, build: Callable[[], DataFrame], sub: str = "cache") -> DataFrame:
        """The stored table, built and stored first if it isn't there."""
        if not self.exists(name, sub):
            self.save(build(), name, sub)
        return self.load(name, sub)

    def save_csv(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("header", True).csv(self.path(name, kind="csv"))

    def load_csv(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("header", True).csv(self.path(name, kind="csv"))

    def save_json(self, df: DataFrame, name: str) -> None:
        """Rows as JSON lines; NaN and infinities become null."""
        clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
        df.select(*clean).write.mode("overwrite").json(self.path(name, kind="json"))

    def load_json(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).json(self.path(name, kind="json"))


def to_json(value) -> str:
    """A driver-side report as JSON; NaN and infinities become null."""

    def clean(x):
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(clean(value), default=str, indent=1)
