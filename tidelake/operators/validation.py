"""Validation of strategies: full figures, walk-forward, robustness, regimes, grades, random strategies, out-of-sample search, exits on conditions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import stats
from tidelake.functions.scan import non_overlapping
from tidelake.functions.windows import Series, flag

from . import metrics as m
from .features import apply
from .rowops import long_format
from .search import spaced

S = Series("sym", "t")
COST = 0.0012
BARS_A_DAY = 6
# What a strategy has to reach, and how its periods are cut.
MIN_TRADES, MIN_SHARPE, MAX_DRAWDOWN, ALPHA = 30, 0.5, 0.3, 0.05
PERIODS, TRAIN, MIN_TEST = 3, 0.7, 50
DELAYS, COST_FACTORS = (1, 2, 4), (1.5, 2.0)
#: The figures of one period.
FIGURES = ("total_return", "annualized_return", "sharpe", "sortino", "max_drawdown", "win_rate", "avg_win", "avg_loss", "profit_factor", "var_95", "expected_shortfall", "calmar", "t_stat")


def full_metrics(df: DataFrame, key: list[str], cost: float = COST) -> DataFrame:
    """One row per key with every figure of a strategy; rows: key, t, sig, ret, days (of the key's period).

    A bar returns sig * ret, less the cost where it trades; returns and tails
    are those of all bars, win rates and ratios those of trades. Fewer than
    five trades give zeros and p = 1.
    """
    s = Series(key, "t")
    traded = F.col("sig") != 0
    df = df.select(*key, "t", "days", traded.alias("traded"), (F.col("sig") * F.col("ret") - F.when(traded, cost).otherwise(0.0)).alias("r"))
    df = apply(df, {"equity": s.cumprod(1 + F.col("r"))}, {"drawdown": F.col("equity") / s.cummax("equity") - 1})
    tail = df.groupBy(*key).agg(F.when(F.count("*") > 20, F.percentile("r", 0.05)).otherwise(0.0).alias("var_95"))
    df = df.join(tail, key)  # one row for each key
    r, x, days = F.col("r"), F.when(F.col("traded"), F.col("r")), F.max("days")
    n, bars = F.count(x), F.count("*")
    total = F.product(1 + r) - 1
    year = n / days * 365
    sd, down = F.stddev_samp(x), F.stddev_samp(F.when(x < 0, x))
    sharpe = F.coalesce(F.when(sd > 0, F.avg(x) / sd * F.sqrt(year)), F.lit(0.0))
    gain, loss = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0)))
    below = F.avg(F.when(r <= F.col("var_95"), r))
    out = df.groupBy(*key).agg(
        n.alias("n_trades"),
        total.alias("total_return"),
        (F.pow(F.greatest(1 + total, F.lit(0.0)), 365 / (bars / BARS_A_DAY)) - 1).alias("annualized_return"),
        sharpe.alias("sharpe"),
        F.when(sd > 0, F.coalesce(F.when(down > 0, F.avg(x) / down * F.sqrt(year)), sharpe * 1.5)).otherwise(0.0).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(x < 0, x)), F.lit(0.0)).alias("avg_loss"),
        (gain / (loss + 1e-8)).alias("profit_factor"),
        F.max("var_95").alias("var_95"),
        F.coalesce(below, F.max("var_95")).alias("expected_shortfall"),
        F.when(bars >= 20, F.try_divide(F.avg(r), F.stddev_samp(r) / F.sqrt(bars))).otherwise(0.0).alias("t_stat"),
        bars.alias("bars"),
    )
    out = out.withColumn("calmar", F.col("annualized_return") / (F.abs("max_drawdown") + 1e-8))
    enough = F.col("n_trades") >= 5
    p = F.when(F.col("bars") >= 20, F.coalesce(stats.t_pvalue(F.col("t_stat"), F.col("bars")), F.lit(2.0)) / 2).otherwise(1.0)
    out = out.withColumn("p_value", F.when(enough, p).otherwise(1.0))
    return out.select(*key, F.when(enough, F.col("n_trades")).otherwise(0).alias("n_trades"), *[F.when(enough, F.col(c)).otherwise(0.0).alias(c) for c in FIGURES], "p_value", (F.col("p_value") < ALPHA).alias("significant"))


def views(df: DataFrame, signal: str = "sig", ret: str = "ret", vol: str | None = None, trend: str | None = None, holding: int = 6, periods: int = PERIODS, train: float = TRAIN, min_test: int = MIN_TEST) -> DataFrame:
    """Every period in which a strategy is looked at, as rows (sym, view, t, sig, ret, days).

    Views: train and test of each walk-forward period (overlapping trades
    removed in each), halves, delayed signals, the whole, and regimes of
    volatility and trend by their medians.
    """
    df = df.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    df = df.select("sym", "t", F.col(signal).cast("double").alias("raw"), F.col(ret).cast("double").alias("ret"), *[F.col(c).cast("double").alias(a) for c, a in ((vol, "vol"), (trend, "trend")) if c])
    df = non_overlapping(df, "raw", "keep", holding, order=("t",))
    df = apply(df, {"sig": F.col("raw") * F.col("keep"), "i": S.row() - 1, "n": F.count("*").over(Window.partitionBy("sym"))})
    size = F.floor(F.col("n") / periods)
    period = F.least(F.floor(F.col("i") / F.greatest(size, F.lit(1))), F.lit(periods - 1))
    df = apply(df, {"period": period.cast("int"), "size": size})
    end = F.when(F.col("period") < periods - 1, (F.col("period") + 1) * F.col("size")).otherwise(F.col("n"))
    cut = F.floor((end - F.col("period") * F.col("size")) * train)
    df = apply(df, {"first": F.col("i") - F.col("period") * F.col("size") < cut, "train_bars": cut, "test_bars": end - F.col("period") * F.col("size") - cut})
    df = non_overlapping(df, "sig", "again", holding, key=("sym", "period", "first"), order=("t",))
    half = F.floor(F.col("n") / 2)
    days = lambda bars: F.greatest(F.lit(1), F.floor(bars / BARS_A_DAY)).cast("double")
    view = lambda name, sig, d, when: F.when(when, F.struct(name.alias("view"), sig.cast("double").alias("sig"), d.alias("days")))
    own = F.col("sig")
    walked = (F.col("size") >= 2 * min_test) & (F.col("test_bars") >= min_test)
    part = F.concat(F.lit("period"), F.col("period").cast("string"), F.when(F.col("first"), "_train").otherwise("_test"))
    out = [view(part, own * F.col("again"), days(F.when(F.col("first"), F.col("train_bars")).otherwise(F.col("test_bars"))), walked)]
    out.append(view(F.when(F.col("i") < half, "half1").otherwise("half2"), own, days(half), F.lit(True)))
    out.append(view(F.lit("whole"), own, days(F.col("n")), F.lit(True)))
    df = apply(df, {f"late{k}": F.coalesce(S.lag("sig", k), F.lit(0.0)) for k in DELAYS})
    out += [view(F.lit(f"delay{k}"), F.col(f"late{k}"), days(F.col("n")), F.lit(True)) for k in DELAYS]
    for c, low, high in ((vol and "vol", "low_volatility", "high_volatility"), (trend and "trend", "ranging", "trending")):
        if c:
            mid = df.groupBy("sym").agg(F.percentile(c, 0.5).alias(f"mid_{c}"))  # one row for each series
            df = df.join(mid, "sym")
            here = F.when(F.col(c) <= F.col(f"mid_{c}"), low).when(F.col(c) > F.col(f"mid_{c}"), high)
            df = df.withColumn(f"here_{c}", here)
            bars = F.count("*").over(Window.partitionBy("sym", f"here_{c}"))
            df = df.withColumn(f"bars_{c}", bars)
            out.append(view(F.col(f"here_{c}"), own, days(F.col(f"bars_{c}")), F.col(f"here_{c}").isNotNull() & (F.col(f"bars_{c}") >= MIN_TRADES)))
    return df.select("sym", "t", "ret", F.inline(F.array_compact(F.array(*out))))


def validate(df: DataFrame, signal: str = "sig", ret: str = "ret", vol: str | None = None, trend: str | None = None, cost: float = COST, periods: int = PERIODS, **options) -> DataFrame:
    """A whole validation in one call, one row per series: out-of-sample figures, robustness, regimes, warnings, grade, recommendation.

    Series too short for the walk-forward (see ``views``) get grade F and say so.
    """
    rows = views(df, signal, ret, vol, trend, periods=periods, **options)
    one = full_metrics(rows, ["sym", "view"], cost)
    at = lambda c, v: F.max(F.when(F.col("view") == v, F.col(c)))
    pair = one.where(F.col("view").startswith("period")).withColumn("period", F.regexp_extract("view", r"period(\d+)", 1))
    is_sharpe = F.max(F.when(F.col("view").endswith("_train"), F.col("sharpe")))
    test = lambda c: F.max(F.when(F.col("view").endswith("_test"), F.col(c)))
    names = ["n_trades", *FIGURES]
    walk = pair.groupBy("sym", "period").agg(is_sharpe.alias("is_sharpe"), *[test(c).alias(c) for c in names], test("significant").alias("significant"))
    degraded = (F.col("is_sharpe") > 0) & ((F.col("is_sharpe") - F.col("sharpe")) / F.col("is_sharpe") > 0.5)
    weighted = [F.coalesce(F.try_divide(F.sum(F.col("n_trades") * F.col(c)), F.sum("n_trades")), F.lit(0.0)).alias(c) for c in ("total_return", "annualized_return", "sharpe", "sortino", "win_rate", "avg_win", "avg_loss", "profit_factor")]
    mean, sd = F.avg("sharpe"), F.stddev_pop("sharpe")
    walk = walk.groupBy("sym").agg(
        F.count("*").alias("periods"),
        F.sum("n_trades").alias("n_trades"),
        *weighted,
        F.least(F.min("max_drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.least(F.min("var_95"), F.lit(0.0)).alias("var_95"),
        (F.count_if("significant") >= F.floor(F.count("*") / 2)).alias("significant"),
        (1 - sd / (mean + 1e-8)).alias("time_consistency"),
        F.when((F.count("*") > 1) & (mean != 0), 1 - F.least(F.lit(1.0), sd / (F.abs(mean) + 1e-8))).otherwise(0.0).alias("wf_consistency"),
        (1 - F.count_if(degraded) / F.count("*")).alias("degradation_rate"),
        F.count_if(degraded).alias("degraded"),
    )
    first, second = at("sharpe", "half1"), at("sharpe", "half2")
    rest = one.groupBy("sym").agg(
        F.when(first != 0, F.greatest(F.lit(0.0), 1 - F.abs(second - first) / (F.abs(first) + 1e-8))).otherwise(0.5).alias("time_stability"),
        *[F.greatest(F.lit(0.0), at("sharpe", f"delay{k}") / (first + 1e-8)).alias(f"delay_{k}") for k in DELAYS],
        F.map_from_entries(F.sort_array(F.collect_list(F.when(~F.col("view").rlike("^(period|half|delay|whole)"), F.struct("view", "sharpe"))))).alias("regimes"),
    )
    x = F.when(F.col("sig") != 0, F.col("sig") * F.col("ret"))
    dear = [F.when(F.count(x) >= 5, (F.avg(x) - cost * k) / (F.stddev_samp(x) + 1e-8) * F.sqrt(F.count(x) / 90 * 365)).otherwise(0.0).alias(f"cost_{k:g}x_sharpe") for k in COST_FACTORS]
    rest = rest.join(rows.where("view = 'whole'").groupBy("sym").agg(*dear, F.count("*").alias("bars")), "sym")
    out = rest.join(walk, "sym", "left")
    ok = F.col("periods").isNotNull() & (F.col("bars") >= 2 * MIN_TRADES)
    robust = (F.col("wf_consistency") + F.col("time_stability") + F.col("degradation_rate")) / 3
    grade = F.when(ok, m.grade(F.col("sharpe"), F.col("win_rate"), F.col("max_drawdown"), F.col("significant"), F.lit(1.0), robust)).otherwise("F")
    warn = {
        "low Sharpe ratio": F.col("sharpe") < MIN_SHARPE,
        "high drawdown": F.col("max_drawdown") < -MAX_DRAWDOWN,
        "few trades": F.col("n_trades") < MIN_TRADES,
        "not significant": ~F.col("significant"),
        "degrades out of sample": F.col("degraded") > F.floor(F.col("periods") / 2),
    }
    warnings = F.when(ok, F.array_compact(F.array(*[F.when(c, n) for n, c in warn.items()]))).otherwise(F.array(F.lit("too little data")))
    out = out.select("*", warnings.alias("warnings"), grade.alias("grade"))
    advice = {"A": "DEPLOY", "B": "CONSIDER", "C": "REFINE", "D": "REVIEW", "F": "REJECT"}
    said = functools.reduce(lambda c, kv: c.when(F.col("grade") == kv[0], kv[1]), advice.items(), F.when(~ok, "FAILED").when(F.col("sharpe") > 10, "DO NOT DEPLOY"))
    return out.withColumn("recommendation", said)


def graded(trades: DataFrame, r: str = "r", days: str = "days") -> DataFrame:
    """Grade of each series of trades (sym, t, r, days) from what they show: Sharpe, win rate, drawdown of the equity,
    a one-sided t-test, and how close the Sharpe ratios of both halves are."""
    df = m.equity(trades.select("sym", "t", F.col(r).alias("r"), F.col(days).alias("days")))
    df = apply(df, {"i": S.row() - 1, "n": F.count("*").over(Window.partitionBy("sym"))})
    part = lambda w: m.sharpe("h04_validator", F.when(w, F.col("r")), F.max("days") / 2)
    early = F.col("i") < F.floor(F.col("n") / 2)
    out = df.groupBy("sym").agg(F.count("r").alias("n"), m.sharpe("h04_validator", F.col("r"), F.max("days")).alias("sharpe"), m.win_rate(F.col("r"), True).alias("win_rate"), F.min("drawdown").alias("max_drawdown"), F.try_divide(F.avg("r"), F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("t"), part(early).alias("s1"), part(~early).alias("s2"))
    robust = F.when(F.col("s1") != 0, F.greatest(F.lit(0.0), 1 - F.abs(F.col("s2") - F.col("s1")) / (F.abs("s1") + 1e-8))).otherwise(0.5)
    p2 = stats.t_pvalue(F.col("t"), F.col("n"))
    out = out.select("*", F.when(F.col("t") > 0, p2 / 2).otherwise(1 - p2 / 2).alias("p"), robust.alias("robust"))
    return out.withColumn("grade", m.grade(F.col("sharpe"), F.col("win_rate"), F.col("max_drawdown"), F.col("p") < ALPHA, F.col("p"), F.col("robust")))


# random strategies
def draw(*parts) -> Column:
    """A number in [0, 1) from the digest of its parts: the same wherever and whenever it is drawn."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long") / 2**32


def monte_carlo(df: DataFrame, signal: str = "sig", ret: str = "ret", runs: int = 1000, days: float = 90, seed: int = 42) -> DataFrame:
    """The strategy of each series against random ones that trade as often: Sharpe and total return, and their place among the runs.

    Each bar is read once and expanded in its task; runs are summed map-side.
    """
    df = df.where(F.col(ret).isNotNull()).select("sym", "t", F.col(ret).alias("ret"), (F.coalesce(F.col(signal), F.lit(0)) * F.col(ret)).alias("own"))
    sharpe = lambda x: F.when(F.count(x) >= 2, F.avg(x) / (F.coalesce(F.stddev_samp(x), F.lit(0.0)) + 1e-8) * F.sqrt(F.count(x) / days * 365)).otherwise(0.0)
    total = lambda x: F.product(1 + x) - 1
    own = F.when(F.col("own") != 0, F.col("own"))
    actual = df.groupBy("sym").agg(F.count(own).alias("n_trades"), (F.count(own) / F.count("*")).alias("rate"), sharpe(own).alias("actual_sharpe"), total(F.col("own")).alias("actual_total"))
    sims = df.join(actual.select("sym", "rate"), "sym").select("sym", "t", "ret", "rate", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))  # one row for each series
    u = draw(F.lit(seed), "run", "sym", "t")
    sims = sims.select("sym", "run", "rate", "ret", u.alias("u"))
    side = F.when(F.col("u") < F.col("rate") / 2, -1.0).when(F.col("u") < F.col("rate"), 1.0).otherwise(0.0)
    sims = sims.select("sym", "run", (side * F.col("ret")).alias("r"))
    traded = F.when(F.col("r") != 0, F.col("r"))
    sims = sims.groupBy("sym", "run").agg(sharpe(traded).alias("sharpe"), total(F.col("r")).alias("total"))
    out = sims.join(actual, "sym").groupBy("sym", "n_trades", "actual_sharpe", "actual_total").agg((F.avg((F.col("sharpe") < F.col("actual_sharpe")).cast("int")) * 100).alias("sharpe_percentile"), (F.avg((F.col("total") < F.col("actual_total")).cast("int")) * 100).alias("total_percentile"), F.avg("sharpe").alias("random_mean"), F.stddev_pop("sharpe").alias("random_std"), F.count("*").alias("runs"))
    few = F.col("n_trades") < 5
    fixed = {"actual_sharpe": 0.0, "actual_total": 0.0, "sharpe_percentile": 50.0, "total_percentile": 50.0, "random_mean": 0.0, "random_std": 0.0}
    out = out.select("sym", "n_trades", *[F.when(few, v).otherwise(F.col(c)).alias(c) for c, v in fixed.items()], "runs")
    return out.withColumn("better_than_random", F.col("sharpe_percentile") > 95)


# search with a threshold fitted in sample
# Thresholds that are tried, and what a rule has to reach.
TRIED = (("pct", 70), ("pct", 80), ("pct", 90), ("z", 1.5), ("z", 2.0))
OOS_LIMITS = {"is_trades": 20, "is_sharpe": 1.5, "oos_trades": 15, "oos_sharpe": 0.5, "retention": 0.3, "excellent": 0.6}


def oos_search(df: DataFrame, columns: list[str], ret: str = "ret", train: float = 0.7, holding: int = 6, limits: dict[str, float] | None = None) -> DataFrame:
    """Every indicator, threshold and direction on trades that don't overlap: figures in and out of sample, retention, verdict.

    A threshold is fitted on the first part of a series; a value above it
    signals one side, one below its negative the other side (none for
    thresholds up to zero). Rules below the in-sample limits are left out.
    """
    limits = OOS_LIMITS | (limits or {})
    n = F.count("*").over(Window.partitionBy("sym"))
    df = apply(df.select("sym", "t", ret, *columns), {"i": (S.row() - 1).cast("double"), "oos": (S.row() - 1) >= F.floor(n * train)})
    long = long_format(df, ["sym", "t", "i", "oos", ret], columns).where("value is not null")
    fit = long.where("not oos").groupBy("sym", "indicator").agg(*[F.percentile("value", v / 100).alias(f"pct{v}") for k, v in TRIED if k == "pct"], F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    spread = F.when(F.col("sd") > 0, F.col("sd")).otherwise(0.0)
    grid = [F.struct(F.lit(f"{k}_{v:g}").alias("config"), (F.col(f"pct{v}") if k == "pct" else F.col("mu") + v * spread).alias("threshold")) for k, v in TRIED]
    fit = fit.select("sym", "indicator", F.array(*grid).alias("grid"))  # one row for each indicator of a series
    side = lambda g: F.when(F.col("value") < -g.threshold, F.when(g.threshold > 0, -1).otherwise(0)).when(F.col("value") > g.threshold, 1).otherwise(0)
    hits = long.join(fit, ["sym", "indicator"]).select("sym", "t", "i", "oos", ret, "indicator", F.inline(F.filter(F.transform("grid", lambda g: F.struct(g.config.alias("config"), side(g).alias("side"))), lambda x: x.side != 0)))
    kept = spaced(hits, ["sym", "indicator", "config", "oos"], holding)
    trades = kept.withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("r", F.col("side") * F.col("direction") * F.col(ret))
    part = lambda o: F.when(F.col("oos") == o, F.col("r"))
    aggs = [e for o, p in ((False, "is"), (True, "oos")) for e in (F.count(F.when(F.col("oos") == o, 1)).alias(f"{p}_n"), m.sharpe("h09_capped_period", part(o)).alias(f"{p}_sharpe"), F.avg((part(o) > 0).cast("int")).alias(f"{p}_win"), F.avg(part(o)).alias(f"{p}_mean"))]
    out = trades.groupBy("sym", "indicator", "config", "direction").agg(*aggs).where((F.col("is_n") >= limits["is_trades"]) & (F.col("is_sharpe") >= limits["is_sharpe"]))
    keep = F.when(F.col("is_sharpe") > 0, F.col("oos_sharpe") / F.col("is_sharpe")).otherwise(0.0)
    out = out.withColumn("retention", keep)
    verdict = F.when(F.col("oos_n") < limits["oos_trades"], "INSUFFICIENT_DATA").when((F.col("oos_sharpe") < limits["oos_sharpe"]) | (F.col("retention") < limits["retention"]), "OVERFIT").when(F.col("retention") >= limits["excellent"], "CREDIBLE").otherwise("MARGINAL")
    return out.withColumn("verdict", verdict)


# exits on conditions, complete strategies
# Exits that are tried, by the columns they look at.
EXITS = (("rsi_14", ">", 70, "overbought"), ("rsi_14", "<", 30, "oversold"), ("macd_histogram", "<", 0, "macd_bearish"), ("macd_histogram", ">", 0, "macd_bullish"), ("bb_position", ">", 1, "bb_upper"), ("bb_position", "<", 0, "bb_lower"))


def _holds(f: str, op: str, x: float):
    return lambda bar: flag(bar[f] > x if op == ">" else bar[f] < x)


def conditional_exits(df: DataFrame, entry: str, direction: int = 1, most: int = 24, min_trades: int = 20, exits=EXITS) -> DataFrame:
    """Trades from bars where ``entry`` holds to the first bar at which a condition does, or ``most`` bars on: per
    series and condition the trades, mean return, mean bars held and share of trades that the condition closed.

    Conditions on columns that are not there are left out; a trade cut off by
    the end of the data counts if its condition came before.
    """
    exits = [e for e in exits if e[0] in df.columns]
    features = list(dict.fromkeys(e[0] for e in exits))
    if not exits:
        return df.sparkSession.createDataFrame([], "sym string, exit string, n long, mean_return double, mean_bars double, hit_rate double")
    rows = apply(df.select("sym", "t", "c", entry, *features), {"path": F.collect_list(F.struct("c", *features)).over(S.ahead(most))}).where(F.col(entry))
    tried = []
    for f, op, x, name in exits:
        tried.append(F.struct(F.lit(name).alias("exit"), F.array_position(F.transform("path", _holds(f, op, x)), F.lit(1)).cast("int").alias("at")))
    rows = rows.select("sym", "c", "path", F.inline(F.array(*tried)))
    bars = F.when(F.col("at") > 0, F.col("at")).when(F.size("path") >= most, most)
    rows = rows.withColumn("bars", bars).where("bars is not null")
    rows = rows.withColumn("r", (F.try_divide(F.get("path", F.col("bars") - 1).c, F.col("c")) - 1) * direction)
    out = rows.groupBy("sym", "exit").agg(F.count("*").alias("n"), F.avg("r").alias("mean_return"), F.avg("bars").alias("mean_bars"), (F.count_if(F.col("at") > 0) / F.count("*")).alias("hit_rate"))
    return out.where(F.col("n") >= min_trades // 2)


def feature_usage(rules: DataFrame, top: int = 10) -> DataFrame:
    """Share of each indicator in the conditions of the best rules (of ``search.ranked``) of all series."""
    best = rules.orderBy(F.desc("confidence"), F.desc("support"), "sym", "indicator", "op", "pct").limit(top)
    return best.groupBy("indicator").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # at most ``top`` rows


def complete_strategy(df: DataFrame, columns: list[str], ret: str = "ret", min_trades: int = 20, pairs: list[tuple[float, float]] = ((1.0, 2.0), (2.0, 4.0)), most: int = 24) -> dict[str, DataFrame]:
    """Entries and exits: the mined rules, the best one's trades with fixed, timed and conditional exits, shares of the features."""
    from . import search, targets

    rules = search.ranked(search.mine(df, columns, ret, min_trades=min_trades, min_win=0.5), 20)
    best = rules.limit(1).collect()
    out = {"entries": rules, "usage": feature_usage(rules)}
    if not best:
        return out
    b = best[0]
    cond = F.col(b.indicator) > b.threshold if b.op == ">" else F.col(b.indicator) < b.threshold
    one = df.where(F.col("sym") == b.sym).withColumn("fires", flag(cond).cast("double"))
    one = non_overlapping(one.drop("entry"), "fires", "entry", order=("t",)).withColumn("entry", F.col("entry") == 1)
    fixed = targets.exits(one, list(pairs), [most], b.direction).where("entry")
    kinds = [c[:-7] for c in fixed.columns if c.startswith("exit_") and c.endswith("_return")]
    rows = fixed.select("sym", F.inline(F.array(*[F.struct(F.lit(k).alias("exit"), F.col(f"{k}_return").alias("r"), F.col(f"{k}_bars").cast("double").alias("bars"), (F.col(f"{k}_type") != 0).alias("hit")) for k in kinds]))).where("r is not null")
    stops = rows.groupBy("sym", "exit").agg(F.count("*").alias("n"), F.avg("r").alias("mean_return"), F.avg("bars").alias("mean_bars"), F.avg(F.col("hit").cast("int")).alias("hit_rate"))
    out["exits"] = stops.unionByName(conditional_exits(one, "entry", b.direction, most, min_trades)).orderBy(F.desc("mean_return"), "exit")
    out["performance"] = one.where(F.col("entry") & F.col(ret).isNotNull()).groupBy("sym").agg(F.count("*").alias("n_trades"), F.avg((F.col(ret) * b.direction > 0).cast("int")).alias("win_rate"), F.avg(F.col(ret) * b.direction).alias("mean_return"))
    return out
