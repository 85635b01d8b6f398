"""Rule search: signals, thresholds fitted in-sample, rule mining, verdicts, anti-patterns, regimes, the critic."""

from __future__ import annotations

import functools
import operator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import stats
from tidelake.functions.gram import correlation_matrix
from tidelake.functions.scan import scan
from tidelake.sources.store import checkpointed
from tidelake.functions.windows import Series, array_mean, array_std, corr, flag, sorted_quantile

from . import bitmaps
from . import metrics as m
from .features import apply
from .rowops import Condition, Rule, long_format

S = Series("sym", "t")
# Percentiles of mined rules, and threshold pairs of the testers.
PERCENTILES = (10, 20, 25, 30, 70, 75, 80, 90)
PAIRS = ((20, 80), (30, 70), (10, 90))
Z_PAIRS = ((-1.5, 1.5), (-2.0, 2.0))
#: Round-trip cost of a tested trade.
COST = 0.0012
LOOKBACK, LEAST_LOOKBACK = 500, 20


# signals
def two_sided(x: Column, lower: Column, upper: Column, direction: int = 1) -> Column:
    return F.when(x < lower, -direction).when(x > upper, direction).otherwise(0)


def zscore_signal(x: Column, mean: Column, std: Column, low: float, high: float, direction: int = 1) -> Column:
    z = F.try_divide(x - mean, std)
    return F.when(z < low, -direction).when(z > high, direction).otherwise(0)


def symmetric(x: Column, threshold: float, direction: int = 1) -> Column:
    """Above the threshold and below its negative; the second is written last, and is flat for thresholds up to 0."""
    return F.when(x < -threshold, -direction if threshold > 0 else 0).when(x > threshold, direction).otherwise(0)


def lookback(n: Column) -> Column:
    """Rows that rolling thresholds look back on: a third of the series, between 20 and 500."""
    return F.greatest(F.lit(LEAST_LOOKBACK), F.least(F.lit(LOOKBACK), F.floor(n / 3))).cast("int")


def recent(df: DataFrame, col: str, out: str, series: Series = S) -> DataFrame:
    """``out``: the sorted values of ``col`` in the look-back of each row, NULL while there are too few.

    The look-back follows from the length of each series; 20 values are
    needed, or 10 in a series that is shorter than its look-back.
    """
    df = apply(df, {"_n": F.count("*").over(Window.partitionBy(*series.key))})
    df = apply(df, {"_xs": series.last_values(col, lookback(F.col("_n")), LOOKBACK)})
    least = F.when(F.col("_n") < LEAST_LOOKBACK, 10).otherwise(20)
    return apply(df, {out: F.when(F.size("_xs") >= least, F.col("_xs"))}).drop("_n", "_xs")


def rolling_percentile(x: Column, values: Column, low: float, high: float, direction: int = 1) -> Column:
    """A two-sided signal by percentiles of the values of ``recent``."""
    return F.coalesce(two_sided(x, sorted_quantile(values, low), sorted_quantile(values, high), direction), F.lit(0))


def rolling_z(x: Column, values: Column, low: float, high: float, direction: int = 1) -> Column:
    mean = array_mean(values)
    return zscore_signal(x, mean, array_std(values, mean) + 1e-10, low, high, direction)


def combine(signals: list[str], unanimous: bool = True) -> Column:
    """1 or -1 where all signals (or more than half of them) are on one side, else 0."""
    count = lambda side: functools.reduce(operator.add, [flag(F.col(s) * side > 0) for s in signals])
    enough = (lambda n: n == len(signals)) if unanimous else (lambda n: n * 2 > len(signals))
    return F.when(enough(count(1)), 1).when(enough(count(-1)), -1).otherwise(0)


def votes(signals: list[str], least: int = 2) -> Column:
    up = functools.reduce(operator.add, [flag(F.col(s) > 0) for s in signals])
    down = functools.reduce(operator.add, [flag(F.col(s) < 0) for s in signals])
    return F.when((up >= least) & (up > down), 1).when((down >= least) & (down > up), -1).otherwise(0)


# mining
def thresholds(long: DataFrame, pcts=PERCENTILES) -> DataFrame:
    """Exact percentiles of every indicator of every series, one row each."""
    at = F.array(*[F.lit(p / 100) for p in pcts])
    th = long.where("value is not null").groupBy("sym", "indicator").agg(F.percentile("value", at).alias("th"))
    return th.select("sym", "indicator", F.posexplode("th").alias("k", "threshold")).select("sym", "indicator", F.get(F.array(*[F.lit(p) for p in pcts]), F.col("k")).alias("pct"), "threshold")


def fired(df: DataFrame, columns: list[str], ret: str = "ret", pcts=PERCENTILES) -> DataFrame:
    """Where rules hold: one row for each bar (with its number i), indicator, percentile and operator that holds.

    A bar meets the thresholds of its indicator as one small array, of which
    only what holds leaves the task.
    """
    base = apply(df.select("sym", "t", ret, *columns), {"i": S.row().cast("double")})
    long = long_format(base, ["sym", "t", "i", ret], columns)
    rules = [F.struct(F.lit(op).alias("op"), F.lit(p).alias("pct"), F.get("th", F.lit(k)).alias("threshold")) for k, p in enumerate(pcts) for op in "><"]
    at = F.array(*[F.lit(p / 100) for p in pcts])
    th = long.where("value is not null").groupBy("sym", "indicator").agg(F.percentile("value", at).alias("th"))
    grid = th.select("sym", "indicator", F.array(*rules).alias("rules"))  # one row for each indicator of a series
    holds = F.filter("rules", lambda r: F.when(r.op == ">", F.col("value") > r.threshold).otherwise(F.col("value") < r.threshold))
    return long.join(grid, ["sym", "indicator"]).select("sym", "t", "i", ret, "indicator", F.inline(holds))


def mine(df: DataFrame, columns: list[str], ret: str = "ret", holding: int = 6, min_trades: int = 20, min_win: float = 0.55, pcts=PERCENTILES) -> DataFrame:
    """Single-threshold rules with their support, win rate and return on trades that don't overlap."""
    key = ["sym", "indicator", "op", "pct"]
    kept = spaced(fired(df, columns, ret, pcts), key, holding)
    out = kept.groupBy(*key, "threshold").agg(F.count("*").alias("support"), F.avg(flag(F.col(ret) > 0)).alias("win"), F.avg(ret).alias("mean"))
    out = out.where((F.col("support") >= min_trades) & ((F.col("win") >= min_win) | (F.col("win") <= 1 - min_win)))
    up = F.col("win") >= 0.5
    return out.select("*", F.when(up, 1).otherwise(-1).alias("direction"), F.when(up, F.col("win")).otherwise(1 - F.col("win")).alias("confidence"))


def ranked(rules: DataFrame, n: int = 20) -> DataFrame:
    return rules.orderBy(F.desc("confidence"), F.desc("support"), "sym", "indicator", "op", "pct").limit(n)


def _choices(sorted_names: Column, size: int) -> Column:
    """All subsets of ``size`` of a sorted array of (indicator, ...) with different indicators, as arrays."""
    if size == 1:
        return F.transform(sorted_names, lambda a: F.array(a))
    rest = lambda i: _choices(F.slice(sorted_names, i + 2, F.size(sorted_names)), size - 1)
    return F.flatten(F.transform(sorted_names, lambda a, i: F.transform(F.filter(rest(i), lambda bs: bs[0].indicator != a.indicator), lambda bs: F.concat(F.array(a), bs))))


def pairs(df: DataFrame, columns: list[str], ret: str = "ret", holding: int = 6, pcts=PERCENTILES, min_trades: int = 15) -> DataFrame:
    """Rules of two conditions on different indicators: rows where both hold, then trades that don't overlap."""
    hits = fired(df, columns, ret, pcts).withColumn("cond", F.concat("indicator", "op", F.col("pct").cast("string")))
    by_row = hits.groupBy("sym", "t", "i").agg(F.first(ret).alias(ret), F.sort_array(F.collect_set(F.struct("indicator", "cond"))).alias("cs"))  # conditions of one row: bounded by the rule grid
    rows = by_row.select("sym", "t", "i", ret, F.explode(_choices(F.col("cs"), 2)).alias("p")).select("sym", "t", "i", ret, F.col("p")[0].cond.alias("a"), F.col("p")[1].cond.alias("b"))
    kept = spaced(rows, ["sym", "a", "b"], holding)
    return kept.groupBy("sym", "a", "b").agg(F.count("*").alias("support"), F.avg(flag(F.col(ret) > 0)).alias("win"), F.avg(ret).alias("mean")).where(F.col("support") >= min_trades)


def pair_rules(df: DataFrame, columns: list[str], ret: str = "ret", holding: int = 6, min_trades: int = 30, min_win: float = 0.52, base: int = 20, most: int = 30, base_trades: int | None = None, base_win: float | None = None, pcts=PERCENTILES) -> DataFrame:
    """Pairs of the conditions of the best rules of each series (``base`` rules, ``most`` conditions), with support, win rate, direction and confidence.

    The pair's trades don't overlap; it is kept if it has ``min_trades`` and
    wins, or loses, often enough: then it is a rule for the other side.
    """
    single = mine(df, columns, ret, holding, min_trades if base_trades is None else base_trades, min_win if base_win is None else base_win, pcts)
    best = F.row_number().over(Window.partitionBy("sym").orderBy(F.desc("confidence"), F.desc("support"), "indicator", "op", "pct"))
    conditions = single.select("sym", "indicator", "op", "pct", "threshold", best.cast("int").alias("k")).where(F.col("k") <= min(base, most))
    bars = apply(df.select("sym", "t", ret, *columns), {"i": S.row()})
    long = long_format(bars, ["sym", "i", ret], columns)
    grid = conditions.groupBy("sym", "indicator").agg(F.collect_list(F.struct("k", "op", "threshold")).alias("rules"))  # at most ``base`` in a series
    holds = F.filter("rules", lambda r: F.when(r.op == ">", F.col("value") > r.threshold).otherwise(F.col("value") < r.threshold))
    hits = long.join(grid, ["sym", "indicator"]).select("sym", "i", F.col(ret).alias("ret"), "indicator", F.explode(F.transform(holds, lambda r: r.k)).alias("k"))
    found = bitmaps.spaced_pairs(hits, holding).where(F.col("support") >= min_trades).withColumn("win", F.col("wins") / F.col("support"))
    found = found.where((F.col("win") >= min_win) | (F.col("win") <= 1 - min_win))
    name = F.concat("indicator", "op", F.col("pct").cast("string"))
    named = lambda c: conditions.select("sym", F.col("k").alias(c), name.alias(f"{c}_name"))
    out = found.join(named("a"), ["sym", "a"]).join(named("b"), ["sym", "b"])
    up = F.col("win") >= 0.5
    return out.select("sym", F.least("a_name", "b_name").alias("a"), F.greatest("a_name", "b_name").alias("b"), "support", "win", F.try_divide("total", "known").alias("mean"), F.when(up, 1).otherwise(-1).alias("direction"), F.when(up, F.col("win")).otherwise(1 - F.col("win")).alias("confidence"))


def spaced(rows: DataFrame, key: list[str], holding: int) -> DataFrame:
    """Of rows that fire (bar number i) those that are ``holding`` bars apart at least, taken greedily."""

    def step(state, i):
        keep, at, free = np.zeros(len(i), np.int64), 0, state if state is not None else -np.inf
        while (at := int(np.searchsorted(i, free))) < len(i):
            keep[at], free = 1, i[at] + holding
        return free, [keep]

    return scan(rows, key, ["i"], ["i"], {"keep": "long"}, step).where("keep = 1").drop("keep")


def similar(rules: list[Rule], tolerance: float = 0.1) -> list[Rule]:
    """Rules left after removing those whose conditions match an earlier rule's within a share of the threshold."""
    out: list[Rule] = []
    for r in rules:
        mine_ = {c.feature: c.threshold for c in r.conditions}
        same = any(len(o.conditions) == len(r.conditions) and (t := {c.feature: c.threshold for c in o.conditions}).keys() == mine_.keys() and all(abs(mine_[f] - t[f]) / (abs(t[f]) + 1e-8) <= tolerance for f in t) for o in out)
        if not same:
            out.append(r)
    return out


def _parts(df: DataFrame, columns: list[str], ret: str, train: float) -> tuple[DataFrame, DataFrame]:
    """Values by indicator (long) with their part of the series, and the days of each part. Rows without a return are left out first."""
    df = df.where(F.col(ret).isNotNull())
    n = F.count("*").over(Window.partitionBy("sym"))
    df = apply(df.select("sym", "t", ret, *columns), {"oos": (S.row() - 1) >= F.floor(n * train)})
    days = df.groupBy("sym", "oos").agg(F.greatest(F.lit(1.0), F.count("*") / 6).alias("days"))  # two rows for each series
    return long_format(df, ["sym", "t", ret, "oos"], columns), days


def _figures(trades: DataFrame, key: list[str], days: DataFrame) -> DataFrame:
    """In-sample and out-of-sample figures of trades (oos, r), both parts in one pass."""
    trades = trades.join(days, ["sym", "oos"])
    part = lambda o: F.when(F.col("oos") == o, F.col("r"))
    day = lambda o: F.max(F.when(F.col("oos") == o, F.col("days")))
    out = [e for o, p in ((False, "is"), (True, "oos")) for e in (F.count(part(o)).alias(f"{p}_n"), m.sharpe("h07_time_based", part(o), day(o)).alias(f"{p}_sharpe"), m.win_rate(part(o), True).alias(f"{p}_win"), F.avg(part(o)).alias(f"{p}_mean"), m.profit_factor(part(o), eps=1e-10).alias(f"{p}_profit_factor"), F.stddev_samp(part(o)).alias(f"{p}_std"))]
    return trades.groupBy(*key).agg(*out)


# What a rule has to reach out of sample.
MIN_OOS_TRADES, MIN_OOS_SHARPE, MIN_RETENTION, MIN_OOS_WIN, MIN_IS_SHARPE = 25, 1.0, 0.4, 0.52, 2.0


def verdicts(figures: DataFrame, min_trades: int = 20, min_oos: int = MIN_OOS_TRADES, min_sharpe: float = MIN_OOS_SHARPE, retention: float = MIN_RETENTION, min_win: float = MIN_OOS_WIN, too_good: bool = True) -> DataFrame:
    """Rules with enough in-sample trades, their retention and verdict; ``too_good`` flags a retention above one."""
    out = figures.where((F.col("is_n") >= max(2, min_trades)) & (F.col("is_std") >= 1e-10))
    enough = (F.col("oos_n") >= min_oos) & (F.col("oos_n") >= 2) & (F.col("oos_std") >= 1e-10)
    keep = F.when(enough, F.col("oos_sharpe") / (F.col("is_sharpe") + 1e-10)).otherwise(0.0)
    good = (F.col("oos_sharpe") >= min_sharpe) & (keep >= retention) & (F.col("oos_win") >= min_win)
    verdict = F.when(~F.coalesce(enough, F.lit(False)), "INSUFFICIENT_DATA").when(F.lit(too_good) & (keep > 1), "SUSPICIOUS_OOS_BETTER").when(good, "CREDIBLE").otherwise("OOS_FAILED")
    return out.select("*", keep.alias("retention"), verdict.alias("verdict"))


def tester(df: DataFrame, columns: list[str], ret: str = "ret", train: float = 0.6, cost: float = COST, **limits) -> DataFrame:
    """Every indicator, direction and threshold pair: figures in-sample and out-of-sample after costs, and a verdict.

    In sample a signal compares a value with thresholds of its look-back; out
    of sample with thresholds fitted once on the whole first part.
    """
    long, days = _parts(df, columns, ret, train)
    series = Series(["sym", "indicator"], "t")
    before = recent(long.where("not oos"), "value", "xs", series)
    before = apply(before, {"mu": array_mean(F.col("xs"))}, {"sd": array_std(F.col("xs"), F.col("mu")) + 1e-10})
    own = [F.struct(F.lit(f"pct_{b}").alias("config"), sorted_quantile(F.col("xs"), a / 100).alias("lo"), sorted_quantile(F.col("xs"), b / 100).alias("hi")) for a, b in PAIRS]
    own += [F.struct(F.lit(f"z_{b:g}").alias("config"), (F.col("mu") + a * F.col("sd")).alias("lo"), (F.col("mu") + b * F.col("sd")).alias("hi")) for a, b in Z_PAIRS]
    inside = before.select("sym", "t", ret, "oos", "indicator", "value", F.inline(F.array(*own)))
    fit = long.where("not oos and value is not null").groupBy("sym", "indicator").agg(*[F.percentile("value", p / 100).alias(f"p{p}") for pair in PAIRS for p in pair], F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"), F.count("value").alias("known"))
    grid = [F.struct(F.lit(f"pct_{b}").alias("config"), F.col(f"p{a}").alias("lo"), F.col(f"p{b}").alias("hi")) for a, b in PAIRS]
    grid += [F.struct(F.lit(f"z_{b:g}").alias("config"), (F.col("mu") + a * (F.col("sd") + 1e-10)).alias("lo"), (F.col("mu") + b * (F.col("sd") + 1e-10)).alias("hi")) for a, b in Z_PAIRS]
    fit = fit.where("known >= 30").select("sym", "indicator", F.array(*grid).alias("grid"))  # one row for each indicator of a series
    outside = long.where("oos").join(fit, ["sym", "indicator"]).select("sym", "t", ret, "oos", "indicator", "value", F.inline("grid"))
    rows = inside.join(fit.select("sym", "indicator"), ["sym", "indicator"], "left_semi").unionByName(outside)
    side = F.when(F.col("value") < F.col("lo"), -1).when(F.col("value") > F.col("hi"), 1).otherwise(0)
    rows = rows.withColumn("side", side).where("side <> 0").withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    trades = rows.withColumn("r", F.col("side") * F.col("direction") * F.col(ret) - cost)
    return verdicts(_figures(trades, ["sym", "indicator", "config", "direction"], days), **limits)


def combinations(df: DataFrame, columns: list[str], size: int = 2, ret: str = "ret", train: float = 0.6, cost: float = COST, unanimous: bool = True, **limits) -> DataFrame:
    """Every set of ``size`` indicators, direction and percentile pair: a trade where all (or more than half) agree.

    Thresholds are those of the look-back within each part of the series. Where
    an indicator fires is a bit vector; sets are combined by ``bitmaps`` without a
    row for each bar and set. The verdict doesn't flag a retention above one.
    """
    df = df.where(F.col(ret).isNotNull())
    numbered = apply(df.select("sym", "t", ret, *columns), {"i": S.row()})
    long, days = _parts(numbered, columns, ret, train)
    rows = recent(long, "value", "xs", Series(["sym", "oos", "indicator"], "t"))
    sides = [F.struct(F.lit(f"pct_{b}").alias("config"), rolling_percentile(F.col("value"), F.col("xs"), a / 100, b / 100).alias("side")) for a, b in PAIRS]
    rows = rows.select("sym", "t", "oos", F.col(ret).alias("ret"), "indicator", F.inline(F.filter(F.array(*sides), lambda x: x.side != 0)))
    hits = rows.join(numbered.select("sym", "t", "i"), ["sym", "t"])
    figures = bitmaps.set_figures(bitmaps.set_sums(hits, columns, size, cost, unanimous), days)
    return verdicts(figures, too_good=False, **limits)


def search(df: DataFrame, columns: list[str], ret: str = "ret", top: int = 50, min_is_sharpe: float = MIN_IS_SHARPE, correlation: float = 0.8, **options) -> dict[str, DataFrame]:
    """Three phases: single indicators, then pairs of the best 20 and triples of the best 15 by in-sample Sharpe.

    ``singles``, ``pairs``, ``triples``: the best ``top`` rules of each phase;
    ``summary``: per phase the rules tested, those that pass in and out of
    sample (correlated signals once), and what chance would give.
    """
    best = lambda d: d.where(F.col("is_sharpe") >= min_is_sharpe)
    order = [F.desc("is_sharpe"), "sym", "indicators", "config", "direction"]
    df = checkpointed(df)
    tested = {"singles": checkpointed(tester(df, columns, ret, **options).withColumnRenamed("indicator", "indicators"))}
    names = list(dict.fromkeys(r.indicators for r in best(tested["singles"]).orderBy(*order).limit(min(20, top)).select("indicators", "is_sharpe").collect()))
    for phase, size, most in (("pairs", 2, 20), ("triples", 3, 15)):
        if len(names[:most]) >= size:
            tested[phase] = checkpointed(combinations(df, names[:most], size, ret, **options))
    out = {p: best(d).orderBy(*order).limit(top) for p, d in tested.items()}
    rows = []
    for p, d in tested.items():
        good = best(d)
        n = d.agg(F.count("*").alias("n"), F.count_if(F.col("is_sharpe") >= min_is_sharpe).alias("passed"), F.count_if((F.col("is_sharpe") >= min_is_sharpe) & (F.col("verdict") == "INSUFFICIENT_DATA")).alias("few")).first()
        lead_of = F.split("indicators", "[+]")[0]
        first = good.where("verdict = 'CREDIBLE'").groupBy(lead_of.alias("lead")).agg(F.max(F.struct("oos_sharpe", "indicators")).oos_sharpe.alias("s")).orderBy(F.desc("s"), "lead").collect()  # one row for each of the columns given
        lead = [r.lead for r in first]
        credible = len(correlated(df, lead, lead, correlation))
        chance = n.n * 0.05
        rows.append((p, n.n, n.passed, credible, n.few, chance, credible / chance if chance else 0.0))
    out["summary"] = df.sparkSession.createDataFrame(rows, "phase string, tested long, passed_is long, credible long, insufficient long, by_chance double, survival double")
    return out


def correlated(df: DataFrame, signals: list[str], best_first: list[str], most: float = 0.8) -> list[str]:
    """Signals left, best first, after removing those that correlate with a better one. One job for all pairs."""
    names = [s for s in best_first if s in signals]
    rho = np.nan_to_num(correlation_matrix(df, names))
    out: list[int] = []
    for k in range(len(names)):
        if all(abs(rho[o, k]) <= most for o in out):
            out.append(k)
    return [names[k] for k in out]


# anti-patterns and regimes
# Parts of names by which columns are known as volatility, trend, hour and weekday, and percentiles of each kind.
VOLATILITY, TREND = ("vol", "atr", "std", "vix"), ("adx", "trend", "momentum", "roc")
HIGH_VOLATILITY, LOW_VOLATILITY, LOW_TREND = (80, 90, 95), (5, 10, 20), (10, 20, 25)
EXTREME_HIGH, EXTREME_LOW = (95, 99), (1, 5)


def _named(columns: list[str], words) -> list[str]:
    return [c for c in columns if any(w in c.lower() for w in words)]


def candidate_patterns(columns: list[str]) -> list[tuple[str, str, int]]:
    """(column, operator, percentile) of the threshold patterns that are tried, by the columns' names."""
    out = [(c, ">", p) for c in _named(columns, VOLATILITY) for p in HIGH_VOLATILITY]
    out += [(c, "<", p) for c in _named(columns, VOLATILITY) for p in LOW_VOLATILITY]
    out += [(c, "<", p) for c in _named(columns, TREND) for p in LOW_TREND]
    out += [(c, ">", p) for c in columns for p in EXTREME_HIGH] + [(c, "<", p) for c in columns for p in EXTREME_LOW]
    return list(dict.fromkeys(out))


def loss_patterns(df: DataFrame, columns: list[str], ret: str = "ret", min_n: int = 50, loss_rate: float = 0.6, confidence: float = 0.8, rules: list[Rule] = ()) -> DataFrame:
    """Conditions under which losses are frequent: sym, pattern, n, losses, loss_rate, mean_loss, frequency, confidence.

    Tried are high and low volatility, weak trends and neutral RSI, hours and
    weekdays, extremes of every column, and given rules (leaves of trees fitted
    to losses). A pattern needs ``min_n`` bars, a share of losses of
    ``loss_rate`` (0.05 more for hours and weekdays) and ``confidence`` by a
    one-sided binomial test. The worst by share times frequency come first
    where they are ordered by ``impact``.
    """
    known = df.where(F.col(ret).isNotNull())
    tried = candidate_patterns(columns)
    pcts = sorted({p for _, _, p in tried})
    hits = fired(known, columns, ret, tuple(pcts))
    wanted = F.concat("indicator", "op", F.col("pct").cast("string"))
    found = [hits.where(wanted.isin([f"{c}{o}{p}" for c, o, p in tried])).select("sym", wanted.alias("pattern"), ret)]
    hour, dow = F.floor((F.col("t") % 86400) / 3600), (F.floor(F.col("t") / 86400) + 3) % 7
    here = [(F.concat(F.lit("hour=="), hour.cast("string")), F.lit(True)), (F.concat(F.lit("dow=="), dow.cast("string")), F.lit(True))]
    here += [(F.lit(f"{c}=40..60"), (F.col(c) > 40) & (F.col(c) < 60)) for c in _named(columns, ("rsi",))]
    here += [(F.lit(r.name), r.column(known.columns)) for r in rules]
    names = F.array(*[F.when(c, n) for n, c in here])
    found.append(known.select("sym", F.explode(F.array_compact(names)).alias("pattern"), ret))
    rows = functools.reduce(DataFrame.unionByName, found)
    size = known.groupBy("sym").agg(F.count("*").alias("bars"))  # one row for each series
    lost = F.col(ret) < 0
    out = rows.groupBy("sym", "pattern").agg(F.count("*").alias("n"), F.count_if(lost).alias("losses"), F.avg(F.when(lost, F.col(ret))).alias("mean_loss")).join(size, "sym")
    out = out.select("*", (F.col("losses") / F.col("n")).alias("loss_rate"), (F.col("n") / F.col("bars")).alias("frequency"))
    least = F.when(F.col("pattern").startswith("hour==") | F.col("pattern").startswith("dow=="), loss_rate + 0.05).otherwise(loss_rate)
    out = out.where((F.col("n") >= min_n) & (F.col("loss_rate") >= least)).drop("bars")
    out = out.select("*", (1 - stats.binomial_pvalue(F.col("losses"), F.col("n"))).alias("confidence"), (F.col("loss_rate") * F.col("frequency")).alias("impact"))
    return out.where(F.col("confidence") > confidence)


def market_regimes(df: DataFrame, vol: str, trend: str, liquidity: str, ret: str = "ret", least: int = 50) -> DataFrame:
    """Volatility by quartiles, trend by the median, liquidity by the lower quartile: win rate, mean return and share of
    the bars of each regime, and what to do in it: avoid below 45 % wins, reduce_size below 50 %, else trade."""
    q = df.groupBy("sym").agg(F.percentile(vol, 0.25).alias("v25"), F.percentile(vol, 0.75).alias("v75"), F.percentile(trend, 0.5).alias("tm"), F.percentile(liquidity, 0.25).alias("l25"))
    known = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in (vol, trend, liquidity, ret)])
    df = df.where(known).join(q, "sym")  # one row for each series
    v = F.when(F.col(vol) <= F.col("v25"), "low_vol").when(F.col(vol) <= F.col("v75"), "normal_vol").otherwise("high_vol")
    t = F.when(F.col(trend) <= F.col("tm"), "weak_trend").otherwise("strong_trend")
    liq = F.when(F.col(liquidity) <= F.col("l25"), "low_liquidity").otherwise("normal_liquidity")
    df = apply(df, {"bars": F.count("*").over(Window.partitionBy("sym"))})  # before rows are multiplied
    rows = df.select("sym", ret, "bars", F.explode(F.array(v, t, liq)).alias("regime"))
    out = rows.groupBy("sym", "regime").agg(F.count("*").alias("n"), F.avg(flag(F.col(ret) > 0)).alias("win"), F.avg(ret).alias("mean"), (F.count("*") / F.max("bars")).alias("frequency")).where(F.col("n") >= least)
    return out.withColumn("recommendation", F.when(F.col("win") < 0.45, "avoid").when(F.col("win") < 0.5, "reduce_size").otherwise("trade"))


# exits
def time_exit(df: DataFrame, holding: int = 6, cost: float = 0.0) -> DataFrame:
    return apply(df, {"exit_return": F.try_divide(S.lead("c", holding), F.col("c")) - 1 - cost})


# the critic
# Parts of names that look ahead; names without economic sense, whole or in part; names that need company.
LEAKS = ("forward", "future", "next", "target", "return_", "profit", "outcome", "result", "winning", "losing")
RAW_NAMES = ("open", "high", "low", "close", "timestamp", "index")
CALENDAR_NAMES = ("day_of_month", "day_of_week", "week_of_year", "month_of_year", "hour_of_day", "minute_of_hour", "time_day_of_month", "time_week_of_year", "time_month", "time_hour", "time_minute")
LONELY_NAMES = ("volume", "quote_volume")
#: Shares by which thresholds are moved.
MOVES = (-0.05, -0.02, 0.02, 0.05, -0.1, 0.1)


def named_leak(rule: Rule) -> bool:
    return any(k in c.feature.lower() for c in rule.conditions for k in LEAKS)


def red_flagged(rule: Rule) -> bool:
    """Whether a condition is on a raw price or on the calendar."""
    names = [c.feature.lower() for c in rule.conditions]
    return any(n in RAW_NAMES or any(k in n for k in CALENDAR_NAMES) for n in names)


def plausible(rule: Rule) -> bool:
    """No red flag, and not only names that need company."""
    names = [c.feature.lower() for c in rule.conditions]
    lonely = [any(k in n for k in LONELY_NAMES) for n in names]
    return not red_flagged(rule) and not (lonely and all(lonely))


def estimated_regimes(df: DataFrame, ret: str = "ret", k: int = 168) -> DataFrame:
    """``regime``: bull, bear or chop by the mean return of the last k bars against its upper and lower third in the series."""
    df = apply(df, {"_m": S.mean(ret, k)})
    q = df.groupBy("sym").agg(F.percentile("_m", 0.67).alias("_hi"), F.percentile("_m", 0.33).alias("_lo"))  # one row for each series
    return df.join(q, "sym").withColumn("regime", F.when(F.col("_m") < F.col("_lo"), "bear").when(F.col("_m") > F.col("_hi"), "bull").otherwise("chop")).drop("_m", "_hi", "_lo")


def critique(df: DataFrame, rules: list[Rule], ret: str = "ret", regime: str | None = None, holding: int = 6, min_trades: int = 30, tested: int = 500, alpha: float = 0.05, retention: float = 0.5, min_regime: int = 10) -> DataFrame:
    """Ten tests of every rule in one job, and the verdict.

    1 at least ``min_trades`` trades that don't overlap; 2 a positive mean in
    three of four quarters of the series; 3 a one-sided t-test at ``alpha`` over
    the number of features ``tested``, from 10 trades; 4 a positive mean in two
    regimes with ``min_regime`` trades each; 5 four of six moved thresholds with
    10 trades and a positive mean; 6 names with an economic sense; 7 Sharpe on
    the last fifth against the rest; 8 15 trades, more wins than losses and a
    positive mean in the first 70 %; 9 no name that looks ahead; 10 four fifths
    of every feature known. Red flags debunk a rule; else 9 tests make it
    credible, 7 suspicious. Only bars on which a rule fires leave their task.
    """
    if regime is None:
        df, regime = estimated_regimes(df, ret), "regime"
    cols = df.columns
    n = F.count("*").over(Window.partitionBy("sym"))
    base = apply(df, {"i": (S.row() - 1).cast("double"), "cnt": n})
    late = F.col("i") >= F.floor(F.col("cnt") * 0.8)
    runs = []
    for r in rules:
        side = r.signal(cols).cast("double")
        runs.append(F.struct(F.lit(r.name).alias("rule"), F.lit("own").alias("run"), side.alias("s")))
        runs.append(F.struct(F.lit(r.name).alias("rule"), F.lit("late").alias("run"), F.when(late, side).otherwise(0.0).alias("s")))
        for d in MOVES:
            cs = tuple(Condition(c.feature, c.operator, c.threshold * (1 + d) if not isinstance(c.threshold, tuple) else tuple(x * (1 + d) for x in c.threshold)) for c in r.conditions)
            runs.append(F.struct(F.lit(r.name).alias("rule"), F.lit(f"moved{d:g}").alias("run"), Rule(r.name, cs, r.logic, r.direction).signal(cols).cast("double").alias("s")))
    rows = base.select("sym", "t", "i", "cnt", ret, F.col(regime).alias("regime"), F.inline(F.filter(F.array(*runs), lambda x: x.s != 0)))
    kept = spaced(rows, ["rule", "run", "sym"], holding).where(F.col(ret).isNotNull()).withColumn("r", F.col("s") * F.col(ret))
    own, r = F.col("run") == "own", F.col("r")
    quarter = F.least(F.floor(F.col("i") / F.floor(F.col("cnt") / 4)), F.lit(3))
    good = functools.reduce(operator.add, [flag(F.avg(F.when(own & (quarter == k), r)) > 0) for k in range(4)])
    early, first = own & (F.col("i") < F.floor(F.col("cnt") * 0.8)), own & (F.col("i") < F.floor(F.col("cnt") * 0.7))
    mine_, split = F.when(own, r), F.floor(F.col("cnt") * 0.8)
    days = {"is": F.max(F.greatest(F.lit(1.0), split / 6)), "oos": F.max(F.greatest(F.lit(1.0), (F.col("cnt") - split) / 6))}
    aggs = [F.count(mine_).alias("n"), F.avg(mine_).alias("mean"), F.stddev_samp(mine_).alias("std"), good.alias("quarters")]
    aggs += [m.sharpe("h05_critic", F.when(w, r), days[a]).alias(f"{a}_sharpe") for w, a in ((early, "is"), (F.col("run") == "late", "oos"))]
    aggs += [F.count(F.when(first, r)).alias("early_n"), F.avg(F.when(first, flag(r > 0))).alias("early_win"), F.avg(F.when(first, r)).alias("early_mean")]
    moved = [F.when(F.col("run") == f"moved{d:g}", r) for d in MOVES]
    aggs.append(functools.reduce(operator.add, [flag((F.count(x) >= 10) & (F.avg(x) > 0)) for x in moved]).alias("stable"))
    out = kept.groupBy("sym", "rule").agg(*aggs)
    by_regime = kept.where(own).groupBy("sym", "rule", "regime").agg(F.count("*").alias("k"), F.avg("r").alias("mu"))
    by_regime = by_regime.groupBy("sym", "rule").agg(F.count_if((F.col("k") >= min_regime) & (F.col("mu") > 0)).alias("regimes"))
    features = sorted({c.feature for x in rules for c in x.conditions} & set(cols))
    known = df.groupBy("sym").agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f"known_{i}") for i, f in enumerate(features)], F.count("*").alias("bars"))
    facts = []
    for x in rules:
        here = [F.col(f"known_{features.index(c.feature)}") for c in x.conditions if c.feature in features]
        least = F.least(*here) if len(here) > 1 else here[0] if here else F.lit(0.0)
        facts.append(F.struct(F.lit(x.name).alias("rule"), F.lit(named_leak(x)).alias("leak"), F.lit(red_flagged(x)).alias("red"), F.lit(plausible(x)).alias("plausible"), least.alias("coverage")))
    facts = known.select("sym", F.inline(F.array(*facts)))  # one row for each rule and series
    out = facts.join(out, ["sym", "rule"], "left").join(by_regime, ["sym", "rule"], "left").fillna(0, ["n", "quarters", "early_n", "stable", "regimes"]).fillna(0.0, ["is_sharpe", "oos_sharpe"])
    p2 = stats.t_pvalue(F.try_divide(F.col("mean"), F.col("std") / F.sqrt("n")), F.col("n"))
    keep = F.when(F.col("is_sharpe") > 0, F.try_divide(F.col("oos_sharpe"), F.col("is_sharpe"))).otherwise(flag(F.col("oos_sharpe") > 0).cast("double"))
    out = apply(out, {"p": F.when(F.col("mean") > 0, p2 / 2).otherwise(1 - p2 / 2), "retention": keep})
    tests = {
        "sample_size": F.col("n") >= min_trades,
        "time_bias": F.col("quarters") >= 3,
        "multiple_comparisons": (F.col("n") >= 10) & (F.col("p") < alpha / tested),
        "regimes": F.col("regimes") >= 2,
        "sensitivity": F.col("stable") >= 4,
        "economic_name": F.col("plausible"),
        "out_of_sample": (F.col("retention") >= retention) & (F.col("oos_sharpe") > 0),
        "data_snooping": (F.col("early_n") >= 15) & (F.col("early_win") > 0.5) & (F.col("early_mean") > 0),
        "lookahead": ~F.col("leak"),
        "coverage": F.col("coverage") >= 0.8,
    }
    out = apply(out, {f"ok_{k}": F.coalesce(v, F.lit(False)) for k, v in tests.items()})
    out = apply(out, {"passed": functools.reduce(operator.add, [flag(F.col(f"ok_{k}")) for k in tests])})
    verdict = F.when(F.col("red"), "DEBUNKED").when(F.col("passed") >= 9, "CREDIBLE").when(F.col("passed") >= 7, "SUSPICIOUS").otherwise("DEBUNKED")
    return apply(out, {"verdict": verdict})


def statistics(df: DataFrame, r: str = "r") -> DataFrame:
    """t-test, moments, normality (Shapiro-Wilk of up to 1,000 drawn values, and by moments), lag-1 autocorrelation with its test, and runs about the median with theirs, one row per series."""
    df = df.where(F.col(r).isNotNull())
    mid = df.groupBy("sym").agg(F.percentile(r, 0.5).alias("_mid"))  # one row for each series
    df = df.join(mid, "sym").withColumn("_up", flag(F.col(r) > F.col("_mid")))
    df = apply(df, {"prev": S.lag(r), "_was": S.lag("_up")})
    x = F.col(r)
    runs = F.sum(flag(F.signum(x) != F.signum("prev"))) + 1
    median_runs = F.sum(flag(F.col("_up") != F.col("_was"))) + 1
    out = df.groupBy("sym").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"), corr(x, "prev").alias("autocorr"), runs.alias("runs"), median_runs.alias("median_runs"), F.sum("_up").cast("double").alias("_a"))
    t = F.try_divide(F.col("mean"), F.col("std") / F.sqrt("n"))
    a, n = F.col("_a"), F.col("n")
    two = 2 * a * (n - a)
    z = (F.col("median_runs") - (1 + two / n)) / (F.sqrt(F.greatest(two * (two - n) / (n * n * (n - 1)), F.lit(0.0))) + 1e-8)
    out = out.select("*", t.alias("t"), z.alias("runs_z"), stats.t_pvalue(t, n).alias("p"), stats.jarque_bera(F.col("skew"), F.col("kurt"), n).alias("moments_p"), stats.ljung_box_1(F.col("autocorr"), n).alias("ljung_p"), stats.normal_pvalue(z).alias("runs_p"))
    return out.drop("_a").join(stats.normality(df, r), "sym", "left")
