"""Metrics of return series as aggregate expressions: every Sharpe variant, and what backtests report.

A variant is one line of a table; all of them reduce in one pass over the
rows (partial aggregates), so any number of rules, splits and variants can be
grouped at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.windows import Series, clip

from .features import apply

BARS_YEAR = 2190
S = Series("sym", "t")


@dataclass(frozen=True)
class Sharpe:
    """How a Sharpe ratio is computed: spread, guards, and what it is annualised by."""

    ddof: int = 1
    eps: float = 0.0
    at_least: int = 2
    by: str = "bars"  # bars | trades | days90 | capped | share | daily
    limit: float | None = None
    digits: int | None = None
    zero: float = 0.0  # spreads at or below this give 0


#: The variants by name.
SHARPE = {
    "h01_bar": Sharpe(zero=1e-10),
    "h02_trade_frequency": Sharpe(by="trades", digits=4),
    "h03_equity_curve": Sharpe(by="trades", digits=4),
    "h04_validator": Sharpe(by="trades", at_least=5),
    "h05_critic": Sharpe(by="trades", eps=1e-10),
    "h06_rule": Sharpe(by="trades", eps=1e-8),
    "h07_time_based": Sharpe(ddof=0, by="daily", zero=1e-10),
    "h08_time_based_5": Sharpe(ddof=0, by="daily", at_least=5, zero=1e-10),
    "h09_capped_period": Sharpe(by="capped"),
    "h10_backtester": Sharpe(ddof=0),
    "h11_walk_forward": Sharpe(limit=5),
    "h12_anchored": Sharpe(ddof=0, limit=5),
    "h13_votes": Sharpe(ddof=0, by="share"),
    "h14_compare": Sharpe(ddof=0),
    "h15_monte_carlo": Sharpe(by="trades", eps=1e-8),
    "h16_objective": Sharpe(by="trades", at_least=5, zero=1e-8),
    "h17_quality": Sharpe(by="trades"),
    "h18_anchored_correct": Sharpe(ddof=0),
    "h19_cost_stress": Sharpe(by="days90", eps=1e-8, at_least=5),
}


def sharpe(kind: str, r: Column, days: Column | None = None, bars: Column | None = None) -> Column:
    """An aggregate over r (nulls skipped). days: of the period; bars: of the table."""
    k = SHARPE[kind]
    n, mean = F.count(r), F.avg(r)
    std = (F.stddev_samp if k.ddof else F.stddev_pop)(r)
    if k.by == "daily":
        total = F.product(1 + r) - 1
        daily = F.when(total > -1, F.pow(1 + total, 1 / days) - 1).otherwise(-1.0)
        spread = std * F.sqrt(n / days)
        out = F.when((n >= k.at_least) & (spread >= k.zero), F.try_divide(daily, spread) * 365**0.5)
    else:
        year = {"bars": lambda: F.lit(BARS_YEAR), "trades": lambda: n / days * 365, "days90": lambda: n / 90 * 365, "capped": lambda: F.least(n, F.lit(BARS_YEAR)), "share": lambda: BARS_YEAR * n / bars}[k.by]()
        out = F.when((n >= k.at_least) & (std > k.zero), mean / (std + k.eps) * F.sqrt(year))
    out = F.coalesce(out, F.lit(0.0))
    if k.limit:
        out = clip(out, -k.limit, k.limit)
    return F.round(out, k.digits) if k.digits else out


def sortino(r: Column, days: Column) -> Column:
    year, down = F.count(r) / days * 365, F.stddev_samp(F.when(r < 0, r))
    plain = F.try_divide(F.avg(r), F.stddev_samp(r)) * F.sqrt(year)
    return F.coalesce(F.when(down > 0, F.avg(r) / down * F.sqrt(year)), plain * 1.5)


def objective(r: Column, corr: Column, days: Column) -> Column:
    """Sharpe, win rate and correlation in one score."""
    s = sharpe("h16_objective", r, days)
    return 0.5 * clip(s / 3, -1, 1) + 0.3 * (F.avg((r > 0).cast("int")) - 0.5) * 2 + 0.2 * clip(F.coalesce(corr, F.lit(0.0)), -1, 1)


def win_rate(r: Column, zeros: bool = False) -> Column:
    return F.avg((r > 0).cast("int")) if zeros else F.try_divide(F.count_if(r > 0), F.count_if(r != 0))


def profit_factor(r: Column, none: float | None = None, eps: float = 0.0) -> Column:
    gain, loss = F.sum(F.when(r > 0, r).otherwise(0)), F.abs(F.sum(F.when(r < 0, r).otherwise(0)))
    return F.coalesce(F.try_divide(gain, loss + eps), F.lit(none))


def equity(df: DataFrame, r: str = "r", key: str = "sym", t: str = "t", additive: bool = False, start_at_one: bool = True) -> DataFrame:
    """Equity, its peak and drawdown. With start_at_one a losing first trade counts as drawdown."""
    s = Series(key, t)
    df = apply(df, {"equity": 1 + s.cumsum(r) if additive else s.cumprod(1 + F.coalesce(F.col(r), F.lit(0.0)))})
    peak = s.cummax("equity")
    return apply(df, {"drawdown": F.col("equity") / (F.greatest(peak, F.lit(1.0)) if start_at_one else peak) - 1})


def summary(r: Column, days: Column) -> list[Column]:
    """The full set of a strategy's figures as aggregates."""
    wins, losses = F.when(r > 0, r), F.when(r < 0, r)
    return [
        F.count(r).alias("n_trades"),
        (F.product(1 + r) - 1).alias("total_return"),
        F.avg(r).alias("mean_return"),
        F.stddev_samp(r).alias("std_return"),
        sharpe("h04_validator", r, days).alias("sharpe"),
        sortino(r, days).alias("sortino"),
        win_rate(r, zeros=True).alias("win_rate"),
        profit_factor(r).alias("profit_factor"),
        F.avg(wins).alias("avg_win"),
        F.avg(losses).alias("avg_loss"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
        F.percentile(r, 0.05).alias("var95"),
        F.skewness(r).alias("skew"),
        F.kurtosis(r).alias("kurtosis"),
        (F.coalesce(F.avg(wins), F.lit(0.0)) * win_rate(r, True) + F.coalesce(F.avg(losses), F.lit(0.0)) * F.avg((r < 0).cast("int"))).alias("expectancy"),
    ]


def insane(df: DataFrame) -> DataFrame:
    """Rows of metrics with what is implausible about them."""
    why = F.array_compact(F.array(F.when(F.abs("sharpe") > 10, "sharpe"), F.when(F.col("win_rate") > 0.9, "win_rate"), F.when(F.col("n_trades") < 10, "n_trades"), F.when(F.abs("total_return") > 100, "total_return")))
    return df.select("*", why.alias("problems"), (F.size(why) == 0).alias("sane"))


def grade(sharpe_: Column, win: Column, drawdown: Column, significant: Column, p: Column, robust: Column) -> Column:
    """A to F from 100 points: Sharpe 40, win rate, drawdown, significance and robustness (0 to 1) 15 each; a Sharpe over 10 is F."""
    # Points by what is reached.
    points = (
        F.when(sharpe_ >= 2, 40).when(sharpe_ >= 1.5, 35).when(sharpe_ >= 1, 25).when(sharpe_ >= 0.5, 15).when(sharpe_ > 0, 5).otherwise(0)
        + F.when(win >= 0.55, 15).when(win >= 0.52, 10).when(win >= 0.5, 5).otherwise(0)
        + F.when(drawdown > -0.1, 15).when(drawdown > -0.15, 12).when(drawdown > -0.2, 8).when(drawdown > -0.3, 4).otherwise(0)
        + F.when(significant, 15).when(p < 0.1, 8).otherwise(0)
        + F.floor(15 * robust)
    )
    return F.when(sharpe_ > 10, "F").when(points >= 85, "A").when(points >= 70, "B").when(points >= 55, "C").when(points >= 40, "D").otherwise("F")


def confidence(p: Column) -> Column:
    edge = F.abs(p - 0.5)
    return F.when(edge >= 0.2, "HIGH").when(edge >= 0.1, "MEDIUM").when(edge >= 0.05, "LOW").otherwise("NEUTRAL")


def kelly(p: Column, ratio: float = 2.0) -> Column:
    """Half the Kelly fraction, between 0 and a quarter."""
    return F.when(p <= 0.5, 0.0).otherwise(clip((p * ratio - (1 - p)) / ratio / 2, 0.0, 0.25))
