"""Thresholds, weights and groupings of features: scores of many parameter sets in one pass, and searches over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.windows import clip, corr, flag
from tidelake.sources.store import checkpointed

from .features import apply
from .learning import clusters, simplex
from .tuning import evolution, parzen

# Thresholds with their present value and bounds.
THRESHOLDS = {
    "pillar_bullish": (55, 50, 80),
    "pillar_bearish": (45, 20, 50),
    "confidence_threshold": (0.70, 0.50, 0.95),
    "rsi_oversold": (30, 15, 40),
    "rsi_overbought": (70, 60, 85),
    "vix_low": (15, 10, 20),
    "vix_normal": (20, 15, 25),
    "vix_high": (30, 25, 40),
    "funding_extreme_zscore": (2.0, 1.0, 3.0),
    "oi_change_significant": (0.05, 0.02, 0.15),
    "fear_greed_extreme_low": (20, 10, 30),
    "fear_greed_extreme_high": (80, 70, 90),
}
# Assumed groups of features by the beginnings of their names, with weights.
PILLARS = {"derivatives": ("funding_", "oi_", "ls_ratio_"), "liquidations": ("liq_",), "technical": ("rsi_", "ema_", "macd_", "bb_", "momentum_"), "liquidity": ("taker_", "orderbook_")}
PILLAR_WEIGHTS = {"derivatives": 0.35, "liquidations": 0.30, "technical": 0.25, "liquidity": 0.10}
CATEGORY_PILLAR = {"derivatives": "derivatives", "liquidation": "liquidations", "price": "technical", "sentiment": "technical"}
STRUCTURES = {
    "4 pillars": ({"derivatives": ("funding_", "oi_", "ls_ratio_"), "liquidations": ("liq_",), "technical": ("rsi_", "ema_", "macd_", "bb_", "momentum_", "return_"), "liquidity": ("taker_", "orderbook_")}, PILLAR_WEIGHTS),
    "3 pillars": ({"derivatives": ("funding_", "oi_", "ls_ratio_", "taker_"), "liquidations": ("liq_",), "technical": ("rsi_", "ema_", "macd_", "bb_", "momentum_", "return_")}, {"derivatives": 0.40, "liquidations": 0.35, "technical": 0.25}),
    "5 pillars": ({"derivatives": ("funding_", "oi_", "ls_ratio_"), "liquidations": ("liq_",), "technical": ("rsi_", "ema_", "macd_", "bb_", "momentum_"), "liquidity": ("taker_",), "macro": ("vix_", "dxy_", "spy_", "yield_", "fear_greed_")}, {"derivatives": 0.30, "liquidations": 0.25, "technical": 0.20, "liquidity": 0.10, "macro": 0.15}),
    "2 pillars": ({"derivatives": ("funding_", "oi_", "ls_ratio_", "liq_", "taker_"), "technical": ("rsi_", "ema_", "macd_", "bb_", "momentum_", "return_")}, {"derivatives": 0.60, "technical": 0.40}),
}
TRIES = 100
#: Parameter sets scored in one job.
BATCH = 10


def _first(columns: list[str], *words: str) -> str | None:
    """The first column whose name holds all of the words."""
    return next((c for c in columns if all(w in c.lower() for w in words)), None)


def threshold_signal(columns: list[str], p: dict) -> Column:
    """Votes of RSI, open interest, fear and greed, and funding against their thresholds, between -1 and 1; columns that are not there don't vote."""
    votes = F.lit(0.0)
    side = lambda up, down, w: (flag(up) - flag(down)) * w
    if c := _first(columns, "rsi"):
        votes = votes + side(F.col(c) < p["rsi_oversold"], F.col(c) > p["rsi_overbought"], 0.3)
    if c := _first(columns, "oi_change") or _first(columns, "oi_close_change"):
        votes = votes + side(F.col(c) > p["oi_change_significant"], F.col(c) < -p["oi_change_significant"], 0.3)
    if c := _first(columns, "fear_greed") or _first(columns, "fg_"):
        votes = votes + side(F.col(c) < p["fear_greed_extreme_low"], F.col(c) > p["fear_greed_extreme_high"], 0.2)
    if c := _first(columns, "funding", "zscore"):
        votes = votes + side(F.col(c) < -p["funding_extreme_zscore"], F.col(c) > p["funding_extreme_zscore"], 0.2)
    return clip(votes, -1.0, 1.0)


def objectives(df: DataFrame, signals: list[Column], ret: str = "ret") -> list[float]:
    """A score of each signal, all in one pass: half Sharpe by trade frequency, then win rate and correlation with the return.

    A bar trades where its signal is above 0.1 in size; -5 without five trades
    or a spread, -10 below 50 bars.
    """
    r = F.col(ret)
    df = df.where(r.isNotNull())
    aggs = [F.count("*").alias("bars")]
    for i, s in enumerate(signals):
        aggs += [e.alias(f"{n}{i}") for n, e in zip("nmswc", _figures(s, r), strict=True)]
    row = df.agg(*aggs).first()
    return [_score(row.bars, *(row[f"{k}{i}"] for k in "nmswc")) for i in range(len(signals))]


def _figures(s: Column, r: Column) -> list[Column]:
    t = F.when(F.abs(s) > 0.1, s * r)
    return [F.count(t), F.avg(t), F.stddev_samp(t), F.avg(flag(s * r > 0)), corr(s, r)]


def _score(bars: int, n: int, m: float | None, s: float | None, w: float, c: float | None) -> float:
    if bars < 50:
        return -10.0
    if n < 5 or s is None or s < 1e-8:
        return -5.0
    sharpe = m / s * (n / max(1.0, bars / 6) * 365) ** 0.5
    return 0.5 * min(1.0, max(-1.0, sharpe / 3)) + 0.3 * (w - 0.5) * 2 + 0.2 * min(1.0, max(-1.0, c or 0.0))


def objectives_of(df: DataFrame, signal: Callable[[dict[str, Column]], Column], sets: list[dict[str, float]], ret: str = "ret") -> list[float]:
    """The same score of one signal under many parameter sets.

    The sets are one constant array that every row meets, so the plan's
    generated code is the same for each batch of a search.
    """
    names = list(sets[0])
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), *[F.lit(float(p[k])).alias(k) for k in names]) for i, p in enumerate(sets)])).alias("p")
    x = df.where(F.col(ret).isNotNull()).select("*", grid)
    x = x.select(F.col("p.set").alias("set"), F.col(ret).cast("double").alias("r"), signal({k: F.col(f"p.{k}") for k in names}).alias("s"))
    rows = x.groupBy("set").agg(F.count("*").alias("bars"), *[e.alias(n) for n, e in zip("nmswc", _figures(F.col("s"), F.col("r")), strict=True)]).collect()  # one row for each set
    got = {r.set: _score(r.bars, r.n, r.m, r.s, r.w, r.c) for r in rows}
    return [got.get(i, -10.0) for i in range(len(sets))]


def _improvement(base: float, best: float) -> float:
    return (best - base) / abs(base) * 100 if base else 0.0


def best_thresholds(df: DataFrame, columns: list[str], ret: str = "ret", tries: int = TRIES, method: str = "parzen") -> dict:
    """All twelve thresholds searched within their bounds, against their present values, by ``method`` parzen or evolution (``tries`` as many scored sets, about)."""
    df = checkpointed(df)
    score = lambda sets: objectives_of(df, lambda p: threshold_signal(columns, p), sets, ret)
    now = {k: float(v[0]) for k, v in THRESHOLDS.items()}
    base = score([now])[0]
    bounds = {k: (float(v[1]), float(v[2])) for k, v in THRESHOLDS.items()}
    if method == "parzen":
        found, best, history = parzen(score, bounds, tries, batch=BATCH)
    else:
        size = max(5, min(15 * len(bounds), tries // 5))
        found, best, history = evolution(score, bounds, tries // size, size)
    if best <= base:
        found, best = now, base
    return {"thresholds": found, "baseline": base, "score": best, "improvement": _improvement(base, best), "history": history}


def grouped(columns: list[str], groups: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    """Columns of each group by the beginnings of their names."""
    return {g: [c for c in columns if c.startswith(tuple(begin))] for g, begin in groups.items()}


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores of their series; one row of means for each series."""
    stats = df.groupBy("sym").agg(*[e for c in columns for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    wide = df.join(stats, "sym")
    return wide.select(*[((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8)).alias(c) if c in columns else F.col(c) for c in df.columns])


def _mean(columns: list[str]) -> Column:
    known = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    return F.coalesce(F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)), F.lit(0.0))


def combined(groups: dict[str, list[str]], weights: dict[str, float]) -> Column:
    """Weighted sum of the groups' mean z-scores."""
    parts = [_mean(cs) * weights.get(g, 0.0) for g, cs in groups.items() if cs]
    return sum(parts, F.lit(0.0))


def _ranked(df: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """Each score as its rank in the series, from -1 to 1."""
    df = apply(df, {f"_{k}": v for k, v in scores.items()})
    rank = lambda k: F.percent_rank().over(Window.partitionBy("sym").orderBy(f"_{k}"))
    return apply(df, {k: (rank(k) - 0.5) * 2 for k in scores})


def structures(df: DataFrame, columns: list[str], ret: str = "ret", important: list[str] | None = None) -> list[tuple[str, dict, dict, float]]:
    """Groupings (4, 3, 5 and 2 pillars, the best 20 features, clusters of features) with their score, best first."""
    tried = {n: (grouped(columns, g), w) for n, (g, w) in STRUCTURES.items()}
    tried["flat"] = ({"all": (important or columns)[:20]}, {"all": 1.0})
    k, place = clusters(df, columns)
    if k:
        groups = {f"cluster_{i}": [c for c in columns if place.get(c) == i] for i in range(k)}
        tried[f"{k} clusters"] = (groups, dict.fromkeys(groups, 1 / k))
    names = {f"score_{i}": n for i, n in enumerate(tried)}
    z = normalised(df, columns)
    ranked = _ranked(z, {c: combined(*tried[n]) for c, n in names.items()})
    found = objectives(ranked, [F.col(c) for c in names], ret)
    out = [(n, *tried[n], s) for n, s in zip(names.values(), found, strict=True)]
    return sorted(out, key=lambda x: (-x[3], x[0]))


def best_weights(df: DataFrame, columns: list[str], groups: dict[str, list[str]], start: dict[str, float], ret: str = "ret", tries: int = TRIES) -> dict:
    """Weights of the groups, on the simplex, searched against those given. Every batch of sets is scored in one job."""
    live = {g: cs for g, cs in groups.items() if cs}
    z = checkpointed(apply(normalised(df, columns), {f"g_{g}": _mean(cs) for g, cs in live.items()}).select(ret, *[f"g_{g}" for g in live]))

    def score(sets):
        # the size of a signal matters for what trades: it is bounded by the weights' sum
        signal = lambda w: clip(sum((F.col(f"g_{g}") * w[g] for g in live), F.lit(0.0)), -1.0, 1.0)
        return objectives_of(z, signal, [simplex(s) for s in sets], ret)

    begin = simplex({g: start.get(g, 0.0) for g in live})
    base = score([begin])[0]
    found, best, _ = parzen(score, dict.fromkeys(live, (0.01, 0.99)), tries, batch=BATCH)
    found = simplex(found)
    if best <= base:
        found, best = begin, base
    return {"weights": found, "baseline": base, "score": best, "improvement": _improvement(base, best)}


def full_optimisation(df: DataFrame, columns: list[str], ret: str = "ret", important: list[str] | None = None, tries: int = TRIES) -> dict:
    """Thresholds, the best grouping and its weights, and what to change."""
    thresholds = best_thresholds(df, columns, ret, tries)
    ranking = structures(df, columns, ret, important)
    name, groups, weights, score = ranking[0]
    tuned = best_weights(df, columns, groups, weights, ret, tries)
    said = []
    if thresholds["improvement"] > 5:
        said.append("update thresholds")
    if name != "4 pillars":
        said.append(f"restructure: {name}")
    if tuned["improvement"] > 5:
        said.append("update weights")
    return {"thresholds": thresholds, "structure": [(n, s) for n, _, _, s in ranking], "weights": tuned, "recommendations": said}


def validated_pillars(shares: DataFrame) -> DataFrame:
    """Assumed pillar weights against the shares of importance by category (category, share): per pillar the assumed and
    the actual weight, the deviation, the share outside all pillars, and what to do."""
    pairs = [x for c, p in CATEGORY_PILLAR.items() for x in (F.lit(c), F.lit(p))]
    placed = shares.select(F.create_map(*pairs)[F.col("category")].alias("pillar"), "share")
    assumed = F.explode(F.array(*[F.struct(F.lit(p).alias("pillar"), F.lit(w).alias("assumed")) for p, w in PILLAR_WEIGHTS.items()])).alias("p")
    outside = placed.agg(F.coalesce(F.sum(F.when(F.col("pillar").isNull(), F.col("share"))), F.lit(0.0)).alias("outside"))
    base = outside.select("outside", assumed).select("outside", "p.*")  # one row for each pillar
    actual = placed.where("pillar is not null").groupBy("pillar").agg(F.sum("share").alias("actual"))
    out = base.join(actual, "pillar", "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))
    out = out.withColumn("deviation", F.col("actual") - F.col("assumed"))
    most = F.max(F.abs("deviation")).over(Window.partitionBy())
    return out.withColumn("recommendation", F.when(F.col("outside") > 0.2, "RESTRUCTURE").when(most > 0.15, "REWEIGHT").otherwise("VALIDATE"))


def alternatives(shares: dict[str, float]) -> list[str]:
    """Groupings worth trying, by the shares of importance of categories."""
    out = ["3 pillars"] if shares.get("liquidity", 0.0) < 0.05 else []
    return out + (["5 pillars"] if shares.get("macro", 0.0) > 0.1 else []) + ["flat"]
