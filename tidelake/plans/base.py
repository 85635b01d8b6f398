"""What the query modules share: tables, bars, rounding, a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import bars as B

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with its SQL (None where SQL can't say it)."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None):
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars4h(spark: SparkSession, sf: str) -> DataFrame:
    return B.bars(table(spark, sf, "events"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Mean order price of each day, one series for each order status."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("sym"), B.floor_time(B.epoch("o_orderdate"), B.DAY).alias("t")).agg(F.round(F.avg("o_totalprice"), 4).alias("c"), F.count("*").cast("double").alias("v"))


DAILY = "bars as (select o_orderstatus as sym, (epoch_us(o_orderdate) // 86400000000) * 86400 as t, round(avg(o_totalprice), 4) as c, count(*)::double as v from orders group by 1, 2)"


def shown(df: DataFrame, *cols: str, key: tuple[str, ...] = ("sym", "t"), digits: int = 6) -> DataFrame:
    """The key and the given columns as rounded doubles."""
    return df.select(*key, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in cols])
