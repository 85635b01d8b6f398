"""Composites of economic series: outer-joined by day, filled forward, with flags and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions.windows import Series
from tidelake.operators.bars import outer_on_time

S = Series("sym", "t")


def composite(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """Series side by side on all their days, each filled forward."""
    df = outer_on_time(frames, ["sym", "t"])
    return df.select("sym", "t", *[S.ffill(c).alias(c) for c in columns])


def yield_curve(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    df = composite(frames, columns)
    return df.select("*", *[(F.col(c) < 0).alias(f"{c}_inverted") for c in columns])


def conditions(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """Indices of financial conditions side by side, with flags above (tight) and below (loose) zero."""
    df = composite(frames, columns)
    return df.select("*", *[(F.col(c) > 0).alias(f"{c}_tight") for c in columns], *[(F.col(c) < 0).alias(f"{c}_loose") for c in columns])


def metadata(frames: dict[str, DataFrame], column: str = "c") -> DataFrame:
    """Rows, known values, first and last day of every series, one row each."""
    rows = [df.agg(F.lit(n).alias("series"), F.count("*").alias("rows"), F.count(column).alias("known"), F.min("t").alias("first"), F.max("t").alias("last")) for n, df in frames.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def inflation(df: DataFrame, c: str, k: int = 12) -> DataFrame:
    """Change over k rows in percent."""
    return df.withColumn(f"{c}_yoy", S.pct_change(c, k) * 100)


def real_yield(df: DataFrame, nominal: str, breakeven: str) -> DataFrame:
    return df.withColumn("real_yield", F.col(nominal) - F.col(breakeven))
