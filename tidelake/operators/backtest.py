"""Backtests: shifted signals, costs, trade logs, splits, walk-forward, regimes, robustness, Monte Carlo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.windows import Series

from . import metrics as m
from .features import apply

S = Series("sym", "t")
COST = 0.0012
#: Cost scenarios: taker fee and slippage a side, funding an interval.
SCENARIOS = {"optimistic": (0.0002, 0.0001, 0.00005), "base": (0.0004, 0.0002, 0.0001), "pessimistic": (0.0005, 0.0004, 0.00015), "high_volume": (0.0003, 0.0003, 0.0001)}


def strategy_returns(df: DataFrame, signal: str = "sig", ret: str = "ret", delay: int = 1) -> DataFrame:
    """The last bar's signal times this bar's return."""
    return apply(df, {"r": F.coalesce(F.lag(signal, delay).over(S.o), F.lit(0)) * F.col(ret)})


def costed(df: DataFrame, signal: str = "sig", ret: str = "ret", cost: float = COST / 2) -> DataFrame:
    """Returns net of a cost whenever the position changes."""
    pos = F.coalesce(F.lag(signal).over(S.o), F.lit(0))
    df = apply(df, {"pos": pos})
    change = F.abs(F.col("pos") - F.coalesce(S.lag("pos"), F.lit(0)))
    return apply(df, {"gross": F.col("pos") * F.col(ret), "r": F.col("pos") * F.col(ret) - cost * change})


def round_trip(taker: float = 0.0004, slippage: float = 0.0002, funding: float = 0.0001, held: float = 0.75) -> float:
    """Cost of a trade: taker fee and slippage twice, funding for the intervals held."""
    return 2 * (taker + slippage) + funding * held


def scenarios(trades: DataFrame, r: str = "r", days: str = "days", costs: dict[str, tuple[float, float, float]] = SCENARIOS) -> DataFrame:
    """Per series and cost scenario: cost a trade, gross and net Sharpe, net return, share of the Sharpe that costs take. One pass."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(round_trip(*c)).alias("cost")) for n, c in costs.items()])).alias("k")
    x = trades.select("sym", r, days, rows).select("sym", days, "k.*", F.col(r).alias("gross"), (F.col(r) - F.col("k.cost")).alias("net"))
    out = x.groupBy("sym", "scenario", "cost").agg(m.sharpe("h08_time_based_5", F.col("gross"), F.first(days)).alias("gross_sharpe"), m.sharpe("h08_time_based_5", F.col("net"), F.first(days)).alias("net_sharpe"), (F.product(1 + F.col("net")) - 1).alias("net_return"), F.avg("net").alias("net_mean"), F.avg((F.col("net") > 0).cast("int")).alias("net_win"))
    return out.withColumn("sharpe_decay", F.when(F.col("gross_sharpe") > 0, (F.col("gross_sharpe") - F.col("net_sharpe")) / F.col("gross_sharpe") * 100).otherwise(0.0))


def trade_log(df: DataFrame, signal: str = "sig", horizon: int = 6, cost: float = COST) -> DataFrame:
    """One row per trade: entry, exit, gross and net return. A signal enters at its bar's close."""
    exit_ = S.lead("c", horizon)
    gross = F.col(signal) * (F.try_divide(exit_, F.col("c")) - 1)
    return df.select("sym", "t", F.col(signal).alias("side"), F.col("c").alias("entry"), exit_.alias("exit"), gross.alias("gross"), (gross - cost).alias("net")).where("side <> 0 and exit is not null")


def ensemble(df: DataFrame, signals: dict[str, float], least: float = 0.3) -> DataFrame:
    """The weighted mean of signals, zero below a least size."""
    total = sum(signals.values())
    pos = sum((F.col(s) * w for s, w in signals.items()), F.lit(0.0)) / total
    return apply(df, {"position": F.when(F.abs(pos) >= least, pos).otherwise(0.0)})


def split(df: DataFrame, train: float = 0.6, test: float = 0.8, purge: int = 12) -> DataFrame:
    """Train, validation and test by place in the series, with a purged gap after each border."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("sym"))
    df = apply(df, {"i": S.row() - 1, "cnt": n})
    a, b, i = F.floor(F.col("cnt") * train), F.floor(F.col("cnt") * test), F.col("i")
    return apply(df, {"split": F.when(i < a, "train").when(i < a + purge, "purge").when(i < b, "val").when(i < b + purge, "purge").otherwise("test")})


def periods(df: DataFrame, n: int = 3, share: float = 0.7) -> DataFrame:
    """Equal periods, each cut into in-sample and out-of-sample."""
    from pyspark.sql import Window

    df = apply(df, {"i": S.row() - 1, "cnt": F.count("*").over(Window.partitionBy("sym"))})
    size = F.floor(F.col("cnt") / n)
    df = apply(df, {"period": F.least(F.floor(F.col("i") / size), F.lit(n - 1)).cast("int"), "size": size})
    return apply(df, {"oos": (F.col("i") - F.col("period") * F.col("size") >= F.floor(F.col("size") * share))})


def folds(df: DataFrame, train: int, test: int, purge: int = 12, expanding: bool = True) -> DataFrame:
    """Walk-forward folds as rows (fold, part): each row of the series once per fold it belongs to; as many folds as the series has."""
    from pyspark.sql import Window

    df = apply(df, {"i": S.row() - 1})
    own = F.ceil((F.count("*").over(Window.partitionBy("sym")) - train - purge) / test).cast("int")
    df = df.withColumn("_n", own).where("_n > 0")
    fold = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("fold")
    out = df.select("*", fold).drop("_n")
    start = train + F.col("fold") * test
    i = F.col("i")
    part = F.when((i >= start + purge) & (i < start + purge + test), "test").when((i < start) & ((i >= 0) if expanding else (i >= start - train)), "train")
    return out.withColumn("part", part).where("part is not null")


def regimes(df: DataFrame, col: str) -> DataFrame:
    """Rows above and at or below the median of a column."""
    q = df.groupBy("sym").agg(F.percentile(col, 0.5).alias("med"))
    return df.join(q, "sym").withColumn("regime", F.when(F.col(col) > F.col("med"), "high").otherwise("low")).drop("med")
