"""Features of long series by carries: one series is worked on by all tasks, with the values of ``features`` and ``scan``.

All take bars with sym and t. Use them where a series is longer than one task
should read; for many short series the one-pass forms are cheaper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions.carry import Before, Ema, Greedy, Running, carried
from tidelake.functions.windows import flag

from .features import EPS, RSI_PERIODS

KEY, ORDER = ["sym"], ["t"]


def ema(df: DataFrame, col: str, out: str, span: float | None = None, alpha: float | None = None, adjust: bool = True) -> DataFrame:
    return carried(df, KEY, ORDER, [col], {out: "double"}, [Ema(alpha or 2 / (span + 1), adjust)])


def cumulative(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Running sums, products and maxima: new column -> (kind, column)."""
    return carried(df, KEY, ORDER, [c for _, c in columns.values()], dict.fromkeys(columns, "double"), [Running(k) for k, _ in columns.values()])


def non_overlapping(df: DataFrame, signal: str, out: str, holding: int = 6) -> DataFrame:
    return carried(df, KEY, ORDER, [signal], {out: "long"}, [Greedy(holding)])


def _with_change(df: DataFrame, col: str = "c") -> DataFrame:
    df = carried(df, KEY, ORDER, [col], {"_before": "double"}, [Before()])
    return df.withColumn("_change", F.col(col) - F.col("_before")).drop("_before")


def rsi(df: DataFrame, periods=RSI_PERIODS) -> DataFrame:
    """price_rsi_p with its oversold and overbought flags."""
    d = F.coalesce("_change", F.lit(0.0))
    df = _with_change(df).select("*", F.greatest(d, F.lit(0.0)).alias("gain"), F.greatest(-d, F.lit(0.0)).alias("loss"))
    out = {f"_{side}_{p}": "double" for p in periods for side in ("up", "down")}
    df = carried(df.drop("_change"), KEY, ORDER, ["gain", "loss"] * len(periods), out, [Ema(2 / (p + 1), False) for p in periods for _ in range(2)])
    value = {p: 100 - 100 / (1 + F.col(f"_up_{p}") / (F.col(f"_down_{p}") + EPS)) for p in periods}
    return df.withColumns({f"price_rsi_{p}": v for p, v in value.items()} | {f"price_rsi_{p}_oversold": flag(v < 30) for p, v in value.items()} | {f"price_rsi_{p}_overbought": flag(v > 70) for p, v in value.items()}).drop(*out)


def obv(df: DataFrame) -> DataFrame:
    """price_obv: the running sum of volume by the sign of the price's change, unknown where that is."""
    df = _with_change(df).withColumn("_signed", F.signum("_change") * F.col("v"))
    df = cumulative(df, {"_obv": ("sum", "_signed")})
    return df.withColumn("price_obv", F.when(F.col("_signed").isNotNull(), F.col("_obv"))).drop("_change", "_signed", "_obv")
