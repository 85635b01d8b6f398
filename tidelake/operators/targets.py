"""Forward-looking targets: returns, risk, classes, path-dependent exits, excursions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.windows import Series, clip, flag, quintile

from .bars import DAY, HOUR, asof, resample
from .features import apply
from .passage import touches

S = Series("sym", "t")
HORIZONS = (1, 3, 6, 12, 18, 42, 84)
COST = 0.0012


def returns(df: DataFrame, hs=HORIZONS, cost: float = COST) -> DataFrame:
    out = {}
    for k in hs:
        r = F.try_divide(S.lead("c", k), F.col("c"))
        out |= {f"return_log_{k}h": F.ln(F.when(r > 0, r)), f"return_simple_{k}h": r - 1, f"return_net_{k}h": r - 1 - cost}
    return apply(df, out)


def sharpe(df: DataFrame, hs=(3, 6, 12)) -> DataFrame:
    """Return over h bars divided by the spread of the last h one-bar forward returns known h bars ahead."""
    df = apply(df, {"fr": F.try_divide(S.lead("c"), F.col("c")) - 1})
    df = apply(df, {f"fs_{k}": S.std("fr", k) for k in hs})
    return apply(df, {f"sharpe_{k}h": (F.try_divide(S.lead("c", k), F.col("c")) - 1) / (S.lead(f"fs_{k}", k) * k**0.5 + 1e-8) for k in hs})


def direction(net: Column, band: float = 0.005) -> Column:
    """-1, 0 or 1 by a band that is closed on the right; unknown stays unknown."""
    return F.when(net > band, 1.0).when(net > -band, 0.0).when(net.isNotNull(), -1.0)


def classes(df: DataFrame, k: int = 6, cost: float = COST, band: float = 0.005, null_as_zero: bool = True) -> DataFrame:
    """Profitable, direction and quintile of the net return over k bars."""
    from pyspark.sql import Window

    r = F.col("r")
    df = apply(df, {"r": F.try_divide(S.lead("c", k), F.col("c")) - 1 - cost})
    profitable = flag(r > 0) if null_as_zero else (r > 0).cast("int")
    rank = F.row_number().over(Window.partitionBy("sym").orderBy(F.col("r").asc_nulls_last(), "t"))
    df = apply(df, {"rk": F.when(r.isNotNull(), rank), "cnt": F.count("r").over(Window.partitionBy("sym"))})
    return apply(df, {f"profitable_{k}h": profitable, f"direction_{k}h": direction(r, band), f"quintile_{k}h": F.when(r.isNotNull(), quintile(F.col("rk"), F.col("cnt")))})


def exits(df: DataFrame, pairs: list[tuple[float, float]], horizons: list[int], direction: int = 1, tag: str = "") -> DataFrame:
    """First touch of stop-loss or take-profit (in percent) within a horizon.

    Each distinct stop and take is looked for once, up to the longest horizon
    (``passage``); pairs and horizons are read from when they are touched.
    Within a bar the stop comes first. A path cut off by the end of the data
    counts if it was touched, else it is unknown.
    """
    down, up = ("low", "high") if direction > 0 else ("high", "low")
    stops = {f"_stop_{k}": (down, 1 - direction * sl / 100) for k, sl in enumerate(dict.fromkeys(sl for sl, _ in pairs))}
    takes = {f"_take_{k}": (up, 1 + direction * tp / 100) for k, tp in enumerate(dict.fromkeys(tp for _, tp in pairs))}
    of_stop = dict(zip(dict.fromkeys(sl for sl, _ in pairs), stops, strict=True))
    of_take = dict(zip(dict.fromkeys(tp for _, tp in pairs), takes, strict=True))
    far = max(horizons)
    found = touches(df, stops | takes, far, tuple(dict.fromkeys(horizons)))
    out = {}
    for sl, tp in pairs:
        stop, take = F.col(of_stop[sl]), F.col(of_take[tp])
        for k in horizons:
            hit = (stop > 0) & (stop <= k) & ((take == 0) | (stop <= take))
            won = (take > 0) & (take <= k) & ((stop == 0) | (take < stop))
            whole = F.col("_ahead") >= k
            n = f"exit{tag}_sl{sl:g}_tp{tp:g}_{k}h"
            end = direction * (F.try_divide(f"_end_{k}", "c") - 1)
            out |= {f"{n}_type": F.when(hit, -1).when(won, 1).when(whole, 0), f"{n}_bars": F.when(hit, stop).when(won, take).when(whole, k), f"{n}_return": F.when(hit, -sl / 100).when(won, tp / 100).when(whole, end)}
    return found.select(*df.columns, *[v.alias(c) for c, v in out.items()])


def vol_adjusted(df: DataFrame, hs=(6, 12)) -> DataFrame:
    """Return over h bars divided by the spread of the past max(24, h) one-bar returns."""
    df = apply(df, {"br": S.pct_change("c")})
    return apply(df, {f"return_vol_adj_{k}h": (F.try_divide(S.lead("c", k), F.col("c")) - 1) / (S.std("br", max(24, k)) + 1e-8) for k in hs})


def excursions(df: DataFrame, hs=(4, 8, 24, 48)) -> DataFrame:
    """Largest adverse and favourable move over the bars ahead, in percent, and their ratio; whole windows only."""
    out = {}
    for k in hs:
        whole = F.count("c").over(S.ahead(k)) == k
        out |= {f"mae_{k}h": 100 * F.when(whole, F.try_divide(F.min("l").over(S.ahead(k)), F.col("c")) - 1), f"mfe_{k}h": 100 * F.when(whole, F.try_divide(F.max("h").over(S.ahead(k)), F.col("c")) - 1)}
    return apply(df, out, {f"mfe_mae_ratio_{k}h": F.col(f"mfe_{k}h") / (F.abs(F.col(f"mae_{k}h")) + 0.01) for k in hs})


def aligned(df: DataFrame, k: int = 6, frames: tuple[int, ...] = (8 * HOUR, DAY), cost: float = COST) -> DataFrame:
    """``tf_alignment_kh``: the mean of the directions over k bars of slower frames, each that of its last bar begun; unknown ones left out."""
    out, names = df.select("sym", "t"), []
    for seconds in frames:
        bars = resample(df, seconds, {"c": "last"})
        name = f"dir_{seconds}"
        bars = apply(bars, {name: direction(F.try_divide(S.lead("c", k), F.col("c")) - 1 - cost)})
        out, names = asof(out, bars.select("sym", "t", name), ["sym"]), [*names, name]
    known = F.array_compact(F.array(*names))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    return out.select("*", mean.alias(f"tf_alignment_{k}h"))


def entry_quality(r: Column, days: float = 90) -> Column:
    """A score of an entry rule's trade returns (an aggregate): profit factor, Sharpe by trade frequency,
    expectancy and number of trades; minus infinity below 30 trades."""
    n, win = F.count(r), F.avg(flag(r > 0).cast("double"))
    gain, loss = F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0))
    pf = F.when(loss == 0, F.lit(10.0)).otherwise(F.abs(F.try_divide(gain, loss)) * win / (1 - win + 1e-8))
    sd = F.stddev_samp(r)
    sharpe_ = F.when(sd > 0, F.try_divide(F.avg(r), sd) * F.sqrt(n / days * 365)).otherwise(0.0)
    expectancy = win * gain + (1 - win) * loss
    score = 0.3 * clip(pf, 0, 10) / 10 + 0.3 * clip(sharpe_, -3, 3) / 3 + 0.2 * clip(expectancy * 100, -10, 10) / 10 + 0.2 * F.least(F.lit(1.0), n / 100)
    return F.when(n < 30, F.lit(float("-inf"))).otherwise(score)


def learning_target(df: DataFrame, k: int = 6) -> DataFrame:
    r = F.try_divide(S.lead("c", k), F.col("c")) - 1
    return apply(df, {"target_return": r, "target_up": (r > 0).cast("int")})
