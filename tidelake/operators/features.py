"""The feature catalogue: stages of named expressions over bars (sym, t, o, h, l, c, v, tb) and source columns.

A stage only uses columns of the bars and of earlier stages, so each stage is
one projection and all its windows share one sort. The suffix h of names
counts bars, as users of such feature tables expect.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.scan import ema, ema_step, scan
from tidelake.functions.windows import Series, clip, flag, row_mean, row_sum  # noqa: F401

S = Series("sym", "t")
EPS = 1e-10
Stage = dict[str, Column]
MA_PERIODS = (6, 8, 12, 13, 21, 34, 42, 55, 84, 89, 144, 180)
RSI_PERIODS = (6, 9, 14, 21, 42)


def _bar(names: str):
    """Columns of the bars by their letters."""
    out = tuple(F.col(x) for x in names)
    return out if len(out) > 1 else out[0]


def apply(df: DataFrame, *stages: Stage) -> DataFrame:
    """Add stages one after another."""
    for s in stages:
        df = df.select("*", *[e.alias(n) for n, e in s.items()])
    return df


def _div(a, b) -> Column:
    return F.try_divide(a, b)


def returns(ks=(1, 3, 6, 12, 42, 84)) -> list[Stage]:
    c = _bar("c")
    return [{f"price_return_{k}h": S.pct_change(c, k) for k in ks} | {f"price_log_return_{k}h": F.ln(F.when(_div(c, S.lag(c, k)) > 0, _div(c, S.lag(c, k)))) for k in ks}]


def atr(ks=(7, 14, 21)) -> list[Stage]:
    c, h, l = _bar("chl")  # noqa: E741
    tr = F.greatest(h - l, F.abs(h - S.lag(c)), F.abs(l - S.lag(c)))
    return [{"tr": tr}, {f"price_atr_{k}": S.mean("tr", k) for k in ks} | {f"price_atr_{k}_pct": _div(S.mean("tr", k), c) for k in ks}]


def volatility(ks=(6, 42, 180), pk=(6, 42)) -> list[Stage]:
    c = _bar("c")
    ratio = _div(c, S.lag(c))
    out = {f"price_realized_vol_{k}h": S.std("lr", k) * math.sqrt(6 * 365) for k in ks}
    return [{"lr": F.ln(F.when(ratio > 0, ratio))}, out | {f"price_parkinson_vol_{k}h": S.parkinson("h", "l", k) for k in pk}]


def sma(ks=(20, 50, 100, 200)) -> list[Stage]:
    c = _bar("c")
    return [{f"price_sma_{k}": S.mean(c, k) for k in ks} | {f"price_vs_sma_{k}": _div(c, S.mean(c, k)) - 1 for k in ks}]


def bollinger(ks=(20, 50)) -> list[Stage]:
    c = _bar("c")
    out = {}
    for k in ks:
        m, s = S.mean(c, k), S.std(c, k)
        out |= {f"price_bb_upper_{k}": m + 2 * s, f"price_bb_lower_{k}": m - 2 * s, f"price_bb_position_{k}": _div(c - (m - 2 * s), 4 * s), f"price_bb_width_{k}": _div(4 * s, m)}
    return [out]


def zscores(col: str = "c", name: str = "price", ks=(24, 168, 720)) -> list[Stage]:
    return [{f"{name}_zscore_{k}h": S.zscore(col, k) for k in ks}]


def ranges(ks=(24, 168, 720)) -> list[Stage]:
    c, h, l = _bar("chl")  # noqa: E741
    out = {}
    for k in ks:
        hi, lo = S.roll(F.max, h, k), S.roll(F.min, l, k)
        out |= {f"price_dist_from_high_{k}": _div(c, hi) - 1, f"price_dist_from_low_{k}": _div(c, lo) - 1, f"price_range_position_{k}": (c - lo) / (hi - lo + EPS)}
    return [out]


def stochastic(ks=(14, 28)) -> list[Stage]:
    c, h, l = _bar("chl")  # noqa: E741
    k_ = lambda k: 100 * (c - S.roll(F.min, l, k)) / (S.roll(F.max, h, k) - S.roll(F.min, l, k) + EPS)
    return [{f"price_stoch_k_{k}": k_(k) for k in ks}, {f"price_stoch_d_{k}": S.mean(f"price_stoch_k_{k}", 3) for k in ks}]


def roc(ks=(10, 20, 50)) -> list[Stage]:
    c = _bar("c")
    return [{f"price_roc_{k}": S.pct_change(c, k) * 100 for k in ks}]


def cci(ks=(14, 20)) -> list[Stage]:
    c, h, l = _bar("chl")  # noqa: E741
    return [{"tp": (h + l + c) / 3}, {f"price_cci_{k}": (F.col("tp") - S.mean("tp", k)) / (0.015 * S.mad("tp", k) + EPS) for k in ks}]


def williams(ks=(14, 28)) -> list[Stage]:
    c, h, l = _bar("chl")  # noqa: E741
    return [{f"price_williams_r_{k}": -100 * (S.roll(F.max, h, k) - c) / (S.roll(F.max, h, k) - S.roll(F.min, l, k) + EPS) for k in ks}]


def volume() -> list[Stage]:
    """Volume over its mean, the change of its 5-bar mean, on-balance volume, distance from the volume-weighted typical price."""
    c, h, l, v = _bar("chlv")  # noqa: E741
    return [
        {"price_volume_sma_20_ratio": v / (S.mean(v, 20) + EPS), "v5": S.mean(v, 5), "dc": F.signum(S.diff(c)) * v, "pv": (h + l + c) / 3 * v},
        {"price_volume_trend_5": S.diff("v5"), "price_obv": F.when(F.col("dc").isNotNull(), S.cumsum("dc")), "price_vwap_6c": S.roll(F.sum, "pv", 6) / (S.roll(F.sum, v, 6) + EPS)},
        {"price_obv_slope": S.diff("price_obv", 5), "price_vwap_dist": _div(c - F.col("price_vwap_6c"), F.col("price_vwap_6c"))},
    ]


def taker(k: int = 42) -> list[Stage]:
    v = _bar("v")
    return [{"taker_buy_ratio": _div(F.col("tb"), v)}, {"price_taker_buy_zscore": S.zscore("taker_buy_ratio", k)}]


def swings(ks=(20, 50)) -> list[Stage]:
    h, l = _bar("hl")  # noqa: E741
    hh, ll = flag(h > S.lag(h)), flag(l < S.lag(l))
    out = {f"price_hh_count_{k}": S.roll(F.sum, "hh", k) for k in ks} | {f"price_ll_count_{k}": S.roll(F.sum, "ll", k) for k in ks}
    return [{"hh": hh, "ll": ll}, out, {f"price_hh_ll_diff_{k}": F.col(f"price_hh_count_{k}") - F.col(f"price_ll_count_{k}") for k in ks}]


def consolidation(ks=(20, 50)) -> list[Stage]:
    h, l = _bar("hl")  # noqa: E741
    span = lambda k: S.roll(F.max, h, k) - S.roll(F.min, l, k)
    return [{f"price_consolidation_{k}": _div(span(k), span(2 * k)) for k in ks}]


def funding(col: str) -> list[Stage]:
    x = F.col(col)
    m, s = S.mean(col, 42), S.std(col, 42)
    return [{f"{col}_zscore_{k}h": S.zscore(col, k) for k in (168, 336, 720)} | {f"{col}_cumul_{k}h": S.roll(F.sum, col, k) for k in (8, 24, 72, 168)} | {f"{col}_extreme_pos": flag(x > m + 2 * s), f"{col}_extreme_neg": flag(x < m - 2 * s)}]


def open_interest(col: str) -> list[Stage]:
    out = {f"{col}_change_{k}h": S.pct_change(col, k) for k in (1, 4, 24, 168)} | {f"{col}_zscore_{k}h": S.zscore(col, k) for k in (168, 720)}
    return [out | {"step": S.diff(col)}, {f"{col}_accel": S.diff("step"), f"{col}_flush": flag(F.col(f"{col}_change_4h") < -0.05)}]


def liquidation(col: str) -> list[Stage]:
    x, m, s = F.col(col), S.mean(col, 42), S.std(col, 42)
    return [{f"{col}_sum_{k}h": S.roll(F.sum, col, k) for k in (24, 168)} | {f"{col}_max_{k}h": S.roll(F.max, col, k) for k in (24, 168)} | {f"{col}_spike": flag(x > m + 3 * s)}]


def long_short(col: str) -> list[Stage]:
    x = F.col(col)
    return [{f"{col}_zscore_{k}h": S.zscore(col, k) for k in (168, 336)} | {f"{col}_extreme_long": flag(x > S.quantile(col, 42, 0.95)), f"{col}_extreme_short": flag(x < S.quantile(col, 42, 0.05))}]


def vix(col: str) -> list[Stage]:
    x = F.col(col)
    regime = {"low": x < 15, "normal": (x >= 15) & (x < 20), "elevated": (x >= 20) & (x < 30), "extreme": x >= 30}
    return [{f"{col}_regime_{n}": flag(e) for n, e in regime.items()} | {f"{col}_zscore_{k}d": S.zscore(col, k) for k in (30, 90, 252)} | {f"{col}_spike": flag(S.pct_change(col) > 0.2)}]


def curve(col: str) -> list[Stage]:
    return [{f"{col}_inverted": flag(F.col(col) < 0)} | {f"{col}_change_{k}d": S.diff(col, k) for k in (5, 20, 60)}]


def dollar(col: str) -> list[Stage]:
    return [{f"{col}_vs_sma50": _div(F.col(col), S.mean(col, 50)) - 1} | {f"{col}_change_{k}d": S.pct_change(col, k) for k in (1, 5, 20)}]


def conditions(col: str) -> list[Stage]:
    return [{f"{col}_tight": flag(F.col(col) > 0), f"{col}_loose": flag(F.col(col) < 0), f"{col}_change_5d": S.diff(col, 5)}]


def fear_greed(col: str) -> list[Stage]:
    x = F.col(col)
    regime = {"extreme_fear": x < 20, "fear": (x >= 20) & (x < 40), "neutral": (x >= 40) & (x < 60), "greed": (x >= 60) & (x < 80), "extreme_greed": x >= 80}
    extreme = flag((x < 20) | (x > 80))
    first = {f"{col}_{n}": flag(e) for n, e in regime.items()} | {f"{col}_zscore_{k}d": S.zscore(col, k) for k in (30, 90)} | {f"{col}_change_7d": S.diff(col, 7), "ext": extreme}
    calm = F.sum(1 - F.col("ext")).over(S.past)
    run = Series(["sym", "calm"], "t")
    return [first, {"calm": calm}, {f"{col}_days_at_extreme": F.sum("ext").over(run.past)}]


def implied(col: str) -> list[Stage]:
    return [{f"{col}_zscore_{k}d": S.zscore(col, k) for k in (30, 90)}]


def calendar() -> list[Stage]:
    """Time features from epoch seconds; no session time zone is involved."""
    t, date = F.col("t"), F.date_from_unix_date(F.floor(F.col("t") / 86400).cast("int"))
    hour = F.floor((t % 86400) / 3600).cast("int")
    two = 2 * math.pi
    first = {"time_hour": hour, "time_dow": F.weekday(date), "time_dom": F.day(date), "time_week": F.weekofyear(date), "time_month": F.month(date)}
    hr, dow, mon = F.col("time_hour"), F.col("time_dow"), F.col("time_month")
    second = {
        "time_hour_sin": F.sin(two * hr / 24),
        "time_hour_cos": F.cos(two * hr / 24),
        "time_dow_sin": F.sin(two * dow / 7),
        "time_dow_cos": F.cos(two * dow / 7),
        "time_month_sin": F.sin(two * mon / 12),
        "time_month_cos": F.cos(two * mon / 12),
        "time_weekend": flag(dow >= 5),
        "time_month_end": flag(F.col("time_dom") >= 28),
        "time_asia": flag((hr >= 0) & (hr < 8)),
        "time_europe": flag((hr >= 7) & (hr < 16)),
        "time_us": flag((hr >= 13) & (hr < 21)),
        "time_us_open": flag((hr >= 14) & (hr < 21) & (dow < 5)),
    }
    return [first, second]


# recursive means: linear scans over sorted series
def ema_features(df: DataFrame, periods=MA_PERIODS) -> DataFrame:
    """price_ema_p, price_vs_ema_p, price_ema_p_slope and the alignment of the five shortest; one pass for all periods."""
    c = _bar("c")
    steps = [ema_step(2 / (p + 1), True) for p in periods]
    df = scan(df, ["sym"], ["t"], ["c"], {f"price_ema_{p}": "double" for p in periods}, _all(steps))
    stage = {f"price_vs_ema_{p}": _div(c, F.col(f"price_ema_{p}")) - 1 for p in periods} | {f"price_ema_{p}_slope": _div(S.diff(f"price_ema_{p}", 4), F.col(f"price_ema_{p}")) for p in periods}
    near = [F.col(f"price_ema_{p}") for p in sorted(periods)[:5]]
    up, down = F.lit(True), F.lit(True)
    for a, b in zip(near, near[1:], strict=False):
        up, down = up & (a <= b), down & (a >= b)
    return apply(df, stage | {"price_ema_alignment": F.when(up, 1).when(down, -1).otherwise(0)})


def _all(steps: list):
    """Several recursive means over the same columns as one step."""

    def step(state, *columns):
        done = [s(x, *columns) for s, x in zip(steps, state or [None] * len(steps), strict=True)]
        return [d[0] for d in done], [o for d in done for o in d[1]]

    return step


def rsi(df: DataFrame, periods=RSI_PERIODS) -> DataFrame:
    """price_rsi_p with its oversold and overbought flags, all periods in one pass.

    Gains and losses are averaged with weight 2 / (p + 1) from the first bar,
    whose change is 0, as are unknown changes.
    """

    def one(alpha: float):
        mean = ema_step(alpha, False)

        def step(state, gain, loss):
            g, s = state or (None, None)
            g, (up,) = mean(g, gain)
            s, (down,) = mean(s, loss)
            return (g, s), [100 - 100 / (1 + up / (down + EPS))]

        return step

    d = F.coalesce(S.diff(_bar("c")), F.lit(0.0))
    df = apply(df, {"gain": F.greatest(d, F.lit(0.0)), "loss": F.greatest(-d, F.lit(0.0))})
    df = scan(df, ["sym"], ["t"], ["gain", "loss"], {f"price_rsi_{p}": "double" for p in periods}, _all([one(2 / (p + 1)) for p in periods]))
    return apply(df, {f"price_rsi_{p}_oversold": flag(F.col(f"price_rsi_{p}") < 30) for p in periods} | {f"price_rsi_{p}_overbought": flag(F.col(f"price_rsi_{p}") > 70) for p in periods})


def macd(df: DataFrame) -> DataFrame:
    for span in (12, 26):
        df = ema(df, "c", f"e{span}", span=span, order=("t",))
    df = apply(df, {"price_macd_line": F.col("e12") - F.col("e26")})
    df = ema(df, "price_macd_line", "price_macd_signal", span=9, order=("t",))
    return apply(df, {"price_macd_histogram": F.col("price_macd_line") - F.col("price_macd_signal")}, {"price_macd_histogram_slope": S.diff("price_macd_histogram")})


# interactions, lags and the shift
def divergences(rsi_cols: list[str], near: int = 6, far: int = 48) -> list[Stage]:
    """A low that fell twice while the indicator turned up, and a high that rose twice while it turned down, at now, near and far bars."""
    out = {}
    turned = lambda x, up: (x > S.lag(x, near)) & (S.lag(x, near) < S.lag(x, far)) if up else (x < S.lag(x, near)) & (S.lag(x, near) > S.lag(x, far))
    went = lambda x, up: (x > S.lag(x, near)) & (S.lag(x, near) > S.lag(x, far)) if up else (x < S.lag(x, near)) & (S.lag(x, near) < S.lag(x, far))
    for r in rsi_cols:
        out |= {f"{r}_bull_div": flag(went(F.col("l"), False) & turned(F.col(r), True)), f"{r}_bear_div": flag(went(F.col("h"), True) & turned(F.col(r), False))}
    return [out]


def oi_price(oi_change: str, price_return: str, funding: str) -> list[Stage]:
    """Open interest against the 6-bar return; funding above its 42-bar mean by a deviation while the price fell."""
    a, b, f = F.col(oi_change), F.col(price_return), F.col(funding)
    high = f > S.mean(funding, 42) + S.std(funding, 42)
    return [{"oi_price_div": flag((a > 0) & (b < 0)), "oi_price_squeeze": flag((a < 0) & (b > 0)), "funding_price_div": flag(high & (b < 0))}]


def crowding(rsi_col: str, flags: list[str], volume_ratio: str) -> list[Stage]:
    """Extremes of an indicator on twice the usual volume, and how many of all oversold (overbought) flags are up, these two included.

    flags: names whose ``_oversold`` and ``_overbought`` columns are counted.
    """
    x, busy = F.col(rsi_col), F.col(volume_ratio) > 2
    both = {"rsi_oversold_vol_spike": flag((x < 30) & busy), "rsi_overbought_vol_spike": flag((x > 70) & busy)}
    count = lambda s: row_sum(*[F.col(f"{r}_{s}").cast("double") for r in flags], F.col(f"rsi_{s}_vol_spike").cast("double"))
    return [both, {"multi_oversold": count("oversold"), "multi_overbought": count("overbought")}]


# What the names of lagged columns hold.
LAGGED_PRICE = ("rsi_14", "zscore_168", "bb_position", "macd_histogram", "ema_alignment")
LAGGED_SOURCES = (("funding", "zscore"), ("oi", "change"), ("fear_greed", "value"))


def lagged_columns(columns: list[str], most: int = 30) -> list[str]:
    """The key columns that get lags: price columns first, then sources; the bound is part of the feature set."""
    price = [x for x in columns if x.startswith("price_") and any(p in x for p in LAGGED_PRICE)]
    sources = [x for a in LAGGED_SOURCES[:2] for x in columns if all(w in x.lower() for w in a)]
    mood = [x for x in columns if all(w in x.lower() for w in LAGGED_SOURCES[2])]
    return list(dict.fromkeys(price + sources + mood))[:most]


def lags(columns: list[str], ks=(4, 24, 48)) -> list[Stage]:
    return [{f"{x}_lag_{k}h": S.lag(x, k) for x in columns for k in ks}]


def liquidation_lags(col: str) -> list[Stage]:
    x = S.lag(col)
    b = f"liq_feat_{re.sub('[^a-z0-9]+', '_', col.lower())}"
    out = {f"{b}_lag_{4 * k}h": S.lag(col, k) for k in (1, 3, 6, 12, 24)}
    second = {}
    for k in (6, 12, 24, 42):
        second |= {f"{b}_sum_{4 * k}h": S.roll(F.sum, "lx", k, 1), f"{b}_mean_{4 * k}h": S.mean("lx", k, 1), f"{b}_max_{4 * k}h": S.roll(F.max, "lx", k, 1)}
    for k in (24, 42, 84):
        second[f"{b}_zscore_{4 * k}h"] = _div(F.col("lx") - S.mean("lx", k, 10), S.std("lx", k, 10) + EPS)
    for k in (1, 3, 6):
        second[f"{b}_mom_{4 * k}h"] = S.diff("lx", k)
    return [{"lx": x} | out, second]


def shifted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns one bar later, so that a row only knows closed bars; each series loses its first row."""
    s = df.select(*[S.lag(x).alias(x) if x in columns else F.col(x) for x in df.columns], S.row().alias("_rn"))
    return s.where("_rn > 1").drop("_rn")


def simple_targets(ks=(1, 4, 8, 24, 48, 168), cost: float = 0.0006, band: float = 0.01) -> list[Stage]:
    c = _bar("c")
    first = {f"target_return_{k}h": _div(S.lead(c, k), c) - 1 for k in ks}
    r = lambda k: F.col(f"target_return_{k}h")
    return [first, {f"target_profitable_{k}h": flag(r(k) > cost) for k in ks} | {f"target_direction_{k}h": F.when(r(k) > band, 1).when(r(k) < -band, -1).otherwise(0) for k in ks}]


# features of the learning stage
def products(a: list[str], b: list[str]) -> list[Stage]:
    return [{f"{x}_x_{y}": F.col(x) * F.col(y) for x in a for y in b}]


def momentum(cols: list[str]) -> list[Stage]:
    return [{f"{x}_mom1": S.diff(x) for x in cols} | {f"{x}_mom3": S.diff(x, 3) for x in cols}, {f"{x}_mom_acc": S.diff(f"{x}_mom1") for x in cols}]


def regimes(col: str, k: int = 50, m: int = 10) -> list[Stage]:
    r = F.col("rank_pct")
    return [{"rank_pct": S.rank_pct(col, k, m)}, {f"{col}_high": flag(r > 0.8), f"{col}_low": flag(r < 0.2), f"{col}_extreme": flag(r > 0.9)}]


def short_z(cols: list[str]) -> list[Stage]:
    """z-scores over 20 bars (5 known at least) and 50 bars (10)."""
    return [{f"{x}_z{k}": _div(F.col(x) - S.mean(x, k, m), S.std(x, k, m) + EPS) for x in cols for k, m in ((20, 5), (50, 10))}]


def crowded(funding: list[str], oi_change: list[str]) -> list[Stage]:
    """Products of up to two funding columns (sums or z-scores) and two changes of open interest."""
    pairs = [(f, o) for f in funding[:2] for o in oi_change[:2]]
    return [{f"crowded_{i}": F.col(f) * F.col(o) for i, (f, o) in enumerate(pairs)}]


def all_price(df: DataFrame) -> DataFrame:
    """The whole price family, level by level."""
    df = rsi(ema_features(macd(df)))
    groups = [returns(), atr(), volatility(), sma(), bollinger(), zscores(), ranges(), stochastic(), roc(), cci(), williams(), volume(), taker(), swings(), consolidation(), calendar()]
    for level in range(max(map(len, groups))):
        stage: Stage = {}
        for g in groups:
            if level < len(g):
                stage |= g[level]
        df = apply(df, stage)
    return df
