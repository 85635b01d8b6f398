"""A seeded synthetic market: hourly prices with regimes and jumps, funding, open interest and the rest."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.scan import scan
from tidelake.functions.windows import Series


def _uniform(seed: int, k: int) -> Column:
    """In (0, 1): 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), "sym", "t"), 12).cast("double") + 0.5) / 2**52


def _normal(seed: int, k: int) -> Column:
    """A standard normal value from two uniform ones."""
    return F.sqrt(-2 * F.ln(_uniform(seed, 2 * k))) * F.cos(2 * math.pi * _uniform(seed, 2 * k + 1))


def market(spark: SparkSession, rows: int = 8760, symbols: int = 1, seed: int = 42, start: int = 1_700_000_000 // 3600 * 3600, patterns: bool = True) -> DataFrame:
    """One row per symbol and hour. Shocks are hashes of seed, symbol and time, the same however rows are dealt; paths with memory are scanned per symbol.

    With ``patterns`` closes hold what a search should find (see ``embedded``).
    """
    df = spark.range(symbols * rows).select((F.col("id") / rows).cast("long").cast("string").alias("sym"), (F.lit(start) + F.col("id") % rows * 3600).alias("t"))
    df = df.select("*", *[_normal(seed, k).alias(f"z{k}") for k in range(6)], _uniform(seed, 99).alias("u"))

    def step(state, z0, z1, z2, z3, z4, z5, u):
        p, regime, fund, oi, fear = state or (30000.0, 0, 1e-4, 1e9, 50.0)
        out = np.empty((len(z0), 7))
        for i in range(len(z0)):
            if u[i] < 0.005:
                regime = (regime + 1) % 3
            r = (0.0001, 0.0, -0.0001)[regime] + 0.005 * (1, 0.6, 1.6)[regime] * z0[i] + (0.03 * z1[i] if u[i] > 0.998 else 0)
            o, p = p, p * np.exp(r)
            wick = abs(z2[i]) * 0.002 * p
            fund = 0.95 * fund + 0.05 * (1e-4 + 0.01 * r) + 5e-5 * z3[i]
            oi *= np.exp(0.3 * r + 0.004 * z4[i])
            fear = min(100.0, max(0.0, 0.97 * fear + 1.5 + 60 * r + 3 * z5[i]))
            out[i] = o, max(o, p) + wick, min(o, p) - wick, p, fund, oi, fear
        return (p, regime, fund, oi, fear), list(out.T)

    names = ["open", "high", "low", "close", "funding_rate", "open_interest", "fear_greed_index"]
    df = scan(df, ["sym"], ["t"], ["z0", "z1", "z2", "z3", "z4", "z5", "u"], dict.fromkeys(names, "double"), step)
    if patterns:
        df = embedded(df, seed)
    r = F.col("close") / F.col("open") - 1
    liq = F.exp(10 + F.abs(r) * 200 + 0.5 * F.col("z1"))
    return df.select(
        "sym",
        "t",
        *names,
        F.exp(6 + F.abs(r) * 60 + 0.3 * F.col("z2")).alias("volume"),
        (liq * F.when(r < 0, 0.8).otherwise(0.3)).alias("long_liquidations"),
        (liq * F.when(r < 0, 0.2).otherwise(0.7)).alias("short_liquidations"),
        (1 + 0.2 * F.col("z3") + 10 * r).alias("long_short_ratio"),
        (18 + 4 * F.col("z4") - 100 * r).alias("vix"),
        (100 + F.col("z5")).alias("dxy"),
        (0.6 + 0.05 * F.abs(F.col("z0"))).alias("implied_volatility"),
    )


#: Patterns in the closes: (column, low, high, rows that follow, push of a row).
PATTERNS = (("funding_rate", -0.0005, 0.0005, 24, 0.001), ("fear_greed_index", 20.0, 80.0, 48, 0.0005))


def embedded(df: DataFrame, seed: int = 42) -> DataFrame:
    """Closes pushed against extremes: after a value above its high bound the next rows are lower, after one below its
    low bound higher, by half to one and a half of the push for each extreme that they follow; highs and lows follow."""
    s = Series("sym", "t")
    push = F.lit(0.0)
    for k, (c, low, high, rows, size) in enumerate(PATTERNS):
        side = F.when(F.col(c) > high, -1.0).when(F.col(c) < low, 1.0).otherwise(0.0)
        push = push + F.coalesce(F.sum(side * size * (0.5 + _uniform(seed, 200 + k))).over(s.o.rowsBetween(-rows, -1)), F.lit(0.0))
    df = df.withColumn("close", F.col("close") * F.exp(push))
    return df.withColumn("high", F.greatest("high", "close")).withColumn("low", F.least("low", "close"))
