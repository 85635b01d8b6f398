"""Window functions and the feature catalogue as queries, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidelake.functions import scan as sc
from tidelake.functions.quantiles import expanding_quantile
from tidelake.functions.sqlkit import P, div, lag, lead, over, roll, staged, zscore
from tidelake.functions.windows import Series, clip, corr, flag, quintile, row_mean, row_sum
from tidelake.operators import bars as B
from tidelake.operators import features as ft
from tidelake.operators import stretched as st

from .base import DAILY, Registry, bars4h, daily, shown

R = Registry()
S = Series("sym", "t")
E = "1e-10"


def stages(name: str, build, *sql: dict[str, str], source=bars4h, head=None):
    """Register a query of feature stages; the SQL's last stage names its columns."""
    cols = list(sql[-1])
    R.add(name, staged(*sql, head=head) if head else staged(*sql))(lambda s, d: shown(ft.apply(source(s, d), *build()), *cols))


def flagged(cond: str) -> str:
    return f"coalesce(({cond})::int, 0)"


def ln_ratio(k: int = 1) -> str:
    r = div("c", lag("c", k))
    return f"ln(case when {r} > 0 then {r} end)"


def _by(*cols):
    from pyspark.sql import Window

    return Window.partitionBy("sym").orderBy(*cols)


def _part(*cols):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


# window functions
stages("w01_lag", lambda: [{"x": S.lag("c", 3)}], {"x": lag("c", 3)})
stages("w02_lead", lambda: [{"x": S.lead("c", 2)}], {"x": lead("c", 2)})
stages("w03_diff", lambda: [{"x": S.diff("c", 4)}], {"x": f"c - {lag('c', 4)}"})
stages("w04_pct_change", lambda: [{"x": S.pct_change("c", 5)}], {"x": f"{div('c', lag('c', 5))} - 1"})
stages("w05_rolling", lambda: [{"mean20": S.mean("c", 20), "sum20": S.roll(F.sum, "c", 20), "max20": S.roll(F.max, "c", 20), "min20": S.roll(F.min, "c", 20), "std20": S.std("c", 20)}], {"mean20": roll("avg", "c", 20), "sum20": roll("sum", "c", 20), "max20": roll("max", "c", 20), "min20": roll("min", "c", 20), "std20": roll("stddev_samp", "c", 20)})
stages("w06_min_periods", lambda: [{"x": S.mean("c", 24, 10), "y": S.std("c", 24, 2)}], {"x": roll("avg", "c", 24, 10), "y": roll("stddev_samp", "c", 24, 2)})
stages("w07_rolling_quantile", lambda: [{"q05": S.quantile("c", 42, 0.05), "q95": S.quantile("c", 42, 0.95)}], {"q05": roll("quantile_cont({}, 0.05)", "c", 42), "q95": roll("quantile_cont({}, 0.95)", "c", 42)})
_exp = f"over ({P} rows unbounded preceding)"
R.add("w08_expanding", staged({n: f"case when count(c) {_exp} >= 10 then {e} {_exp} end" for n, e in (("q", "quantile_cont(c, 0.9)"), ("m", "avg(c)"), ("s", "stddev_samp(c)"))}, digits=9))(
    lambda s, d: shown(expanding_quantile(ft.apply(bars4h(s, d), {"m": S.expand(F.avg, "c", 10), "s": S.expand(F.stddev_samp, "c", 10)}), "c", "q", 0.9, 10), "q", "m", "s", digits=9)
)
_win = f"list(c) {over(30)}"
stages("w09_rank_pct", lambda: [{"x": S.rank_pct("c", 30)}], {"xs": _win}, {"x": "case when len(xs) >= 30 then (len(list_filter(xs, lambda y: y < c)) + (len(list_filter(xs, lambda y: y = c)) + 1) / 2.0) / len(xs) end"})
_hl = f"(ln({div('h', 'l')}))"
stages("w10_parkinson", lambda: [{"x": S.parkinson("h", "l", 6)}], {"p": f"power({_hl}, 2)"}, {"x": f"sqrt({roll('sum', 'p', 6)} / {4 * math.log(2) * 6})"})
stages("w11_mad", lambda: [{"x": S.mad("c", 14)}], {"xs": f"list(c) {over(14)}", "m": f"avg(c) {over(14)}"}, {"x": "case when len(xs) >= 14 then list_avg(list_transform(xs, lambda y: abs(y - m))) end"})
stages("w12_boolean_count", lambda: ft.swings((20,))[:2], {"hh": flagged(f"h > {lag('h')}"), "ll": flagged(f"l < {lag('l')}")}, {"price_hh_count_20": roll("sum", "hh", 20), "price_ll_count_20": roll("sum", "ll", 20)})
stages("w15_cumulative", lambda: [{"s": S.cumsum("c"), "p": S.cumprod(1 + F.col("c") / 1e5), "m": S.cummax("c")}], {"s": f"sum(c) {_exp}", "p": f"product(1 + c / 1e5) {_exp}", "m": f"max(c) {_exp}"})
stages("w16_drawdown", lambda: [{"e": S.cumsum("c")}, {"q": F.col("e") - 40 * S.row()}, {"dd": F.col("q") / F.greatest(S.cummax("q"), F.lit(1.0)) - 1}], {"e": f"sum(c) {_exp}"}, {"q": f"e - 40 * row_number() over ({P})"}, {"dd": f"q / greatest(max(q) {_exp}, 1.0) - 1"})
_hot = flagged("c > 60")
stages("w17_streak", lambda: [{"f": flag(F.col("c") > 60)}, {"g": S.cumsum(1 - F.col("f"))}, {"streak": F.sum("f").over(Series(["sym", "g"], "t").past)}], {"f": _hot}, {"g": f"sum(1 - f) {_exp}"}, {"streak": "sum(f) over (partition by sym, g order by t rows unbounded preceding)"})
stages("w18_ffill_limit", lambda: [{"x": F.when(F.col("c") > 50, F.col("c"))}, {"y": S.ffill("x", 3)}], {"x": "case when c > 50 then c end"}, {"y": f"last_value(x ignore nulls) over ({P} rows between 3 preceding and current row)"})
R.add("w19_ranks", staged({"first": "row_number() over (partition by sym order by c, t)", "pct": "(rank() over (partition by sym order by c) + (count(*) over (partition by sym, c) - 1) / 2.0) / count(*) over (partition by sym)"}))(
    lambda s, d: shown(ft.apply(bars4h(s, d), {"first": F.row_number().over(_by("c", "t")), "pct": (F.rank().over(_by("c")) + (F.count("*").over(_part("sym", "c")) - 1) / 2) / F.count("*").over(_part("sym"))}), "first", "pct")
)


_rk = "row_number() over (partition by sym order by c, t)"
_n = "count(*) over (partition by sym)"
R.add("w20_quintile", staged({"rk": _rk, "cnt": _n}, {"q": "1 + " + " + ".join(f"(rk > 1 + (cnt - 1) * {k / 5})::int" for k in range(1, 5))}))(
    lambda s, d: shown(ft.apply(bars4h(s, d), {"rk": F.row_number().over(_by("c", "t")), "cnt": F.count("*").over(_part("sym"))}, {"q": quintile(F.col("rk"), F.col("cnt"))}), "q")
)
R.add("w21_last_row", staged({"c": "c"}).replace("from bars", "from bars qualify row_number() over (partition by sym order by t desc) = 1"))(
    lambda s, d: shown(bars4h(s, d).groupBy("sym").agg(F.max("t").alias("t"), F.max_by("c", "t").alias("c")), "c")
)
_rec = """with recursive {bars}, n as (select *, row_number() over (partition by sym order by t) as i from bars),
r as (select sym, t, i, c, {first} from n where i = 1 union all select n.sym, n.t, n.i, n.c, {next} from n join r on n.sym = r.sym and n.i = r.i + 1)
select sym, t, round({out}, 6) as {name} from r"""


def recursive(first: str, nxt: str, out: str, name: str) -> str:
    from tidelake.functions.sqlkit import BARS

    return _rec.format(bars=BARS, first=first, next=nxt, out=out, name=name)


_a = 2 / 13
R.add("w13_ema_adjusted", recursive("c as num, 1.0::double as den", f"r.num * {1 - _a} + n.c, r.den * {1 - _a} + 1", "num / den", "ema"))(lambda s, d: shown(sc.ema(bars4h(s, d), "c", "ema", span=12, order=("t",)), "ema"))
R.add("w14_ema_recursive", recursive("c as e", f"r.e * {1 - 1 / 14} + n.c * {1 / 14}", "e", "ema"))(lambda s, d: shown(sc.ema(bars4h(s, d), "c", "ema", alpha=1 / 14, adjust=False, order=("t",)), "ema"))
R.add("w22_non_overlapping", recursive("(c > 60)::int as k, case when c > 60 then 7 else 1 end as nxt", "(n.c > 60 and n.i >= r.nxt)::int, case when n.c > 60 and n.i >= r.nxt then n.i + 6 else r.nxt end", "k::double", "keep"))(
    lambda s, d: shown(sc.non_overlapping(ft.apply(bars4h(s, d), {"sig": flag(F.col("c") > 60).cast("double")}), "sig", "keep", order=("t",)), "keep")
)
# the same over series that are cut into stretches, each a task
R.add("w13_ema_stretches", R.sql["w13_ema_adjusted"])(lambda s, d: shown(st.ema(bars4h(s, d), "c", "ema", span=12), "ema"))
R.add("w14_ema_stretches", R.sql["w14_ema_recursive"])(lambda s, d: shown(st.ema(bars4h(s, d), "c", "ema", alpha=1 / 14, adjust=False), "ema"))
R.add("w15_cumulative_stretches", R.sql["w15_cumulative"])(lambda s, d: shown(st.cumulative(bars4h(s, d).withColumn("q", 1 + F.col("c") / 1e5), {"s": ("sum", "c"), "p": ("product", "q"), "m": ("max", "c")}), "s", "p", "m"))
R.add("w22_non_overlapping_stretches", R.sql["w22_non_overlapping"])(lambda s, d: shown(st.non_overlapping(bars4h(s, d).withColumn("sig", flag(F.col("c") > 60).cast("double")), "sig", "keep"), "keep"))
_r1 = f"{div('c', lag('c'))} - 1"
_returns = staged({"r": _r1}, {"r": "r"}).split(" select sym, t, round")[0]
R.add("w23_autocorrelation", f"{_returns} select sym, round(corr(r, p), 6) as ac from (select sym, r, {lag('r')} as p from s0) group by sym")(
    lambda s, d: ft.apply(bars4h(s, d), {"r": S.pct_change("c")}, {"p": S.lag("r")}).where("r is not null and p is not null").groupBy("sym").agg(F.round(corr("r", "p"), 6).alias("ac"))
)
R.add("w24_runs", f"{_returns} select sym, sum((sign(r) <> p)::int) + 1 as runs from (select sym, r, sign({lag('r')}) as p from s0) where r is not null and p is not null group by sym")(
    lambda s, d: ft.apply(bars4h(s, d), {"r": S.pct_change("c")}, {"p": F.signum(S.lag("r"))}).where("r is not null and p is not null").groupBy("sym").agg((F.sum((F.signum("r") != F.col("p")).cast("int")) + 1).alias("runs"))
)

# price features
_ks = (1, 3, 6, 12, 42, 84)
stages("f01_returns", ft.returns, {f"price_return_{k}h": f"{div('c', lag('c', k))} - 1" for k in _ks} | {f"price_log_return_{k}h": ln_ratio(k) for k in _ks})
stages("f02_atr", ft.atr, {"tr": f"greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))"}, {f"price_atr_{k}": roll("avg", "tr", k) for k in (7, 14, 21)} | {f"price_atr_{k}_pct": div(roll("avg", "tr", k), "c") for k in (7, 14, 21)})
stages("f03_realized_vol", lambda: ft.volatility(pk=()), {"lr": ln_ratio()}, {f"price_realized_vol_{k}h": f"{roll('stddev_samp', 'lr', k)} * sqrt(6 * 365)" for k in (6, 42, 180)})
stages("f04_parkinson_vol", lambda: ft.volatility(ks=()), {"p": f"power({_hl}, 2)"}, {f"price_parkinson_vol_{k}h": f"sqrt({roll('sum', 'p', k)} / {4 * math.log(2) * k})" for k in (6, 42)})
stages("f06_sma", ft.sma, {f"price_sma_{k}": roll("avg", "c", k) for k in (20, 50, 100, 200)} | {f"price_vs_sma_{k}": f"{div('c', roll('avg', 'c', k))} - 1" for k in (20, 50, 100, 200)})
_bb = {}
for _k in (20, 50):
    _m, _s = roll("avg", "c", _k), roll("stddev_samp", "c", _k)
    _bb |= {f"price_bb_upper_{_k}": f"{_m} + 2 * {_s}", f"price_bb_lower_{_k}": f"{_m} - 2 * {_s}", f"price_bb_position_{_k}": div(f"c - ({_m} - 2 * {_s})", f"4 * {_s}"), f"price_bb_width_{_k}": div(f"4 * {_s}", _m)}
stages("f08_bollinger", ft.bollinger, _bb)
R.add("w25_stretches", staged(_bb | {"ahead": f"{div(lead('c', 6), 'c')} - 1"}))(lambda s, d: shown(B.in_stretches(bars4h(s, d), lambda x: ft.apply(x, *ft.bollinger(), {"ahead": F.try_divide(S.lead("c", 6), F.col("c")) - 1}), 50, 6, rows=70, seconds=86400), *_bb, "ahead"))
stages("f09_zscore", ft.zscores, {f"price_zscore_{k}h": zscore("c", k) for k in (24, 168, 720)})
_rg = {}
for _k in (24, 168, 720):
    _hi, _lo = roll("max", "h", _k), roll("min", "l", _k)
    _rg |= {f"price_dist_from_high_{_k}": f"{div('c', _hi)} - 1", f"price_dist_from_low_{_k}": f"{div('c', _lo)} - 1", f"price_range_position_{_k}": f"(c - {_lo}) / ({_hi} - {_lo} + {E})"}
stages("f10_ranges", ft.ranges, _rg)
_st = {f"k{k}": f"100 * (c - {roll('min', 'l', k)}) / ({roll('max', 'h', k)} - {roll('min', 'l', k)} + {E})" for k in (14, 28)}
stages("f12_stochastic", ft.stochastic, _st, {f"price_stoch_k_{k}": f"k{k}" for k in (14, 28)} | {f"price_stoch_d_{k}": roll("avg", f"k{k}", 3) for k in (14, 28)})
stages("f14_roc", ft.roc, {f"price_roc_{k}": f"({div('c', lag('c', k))} - 1) * 100" for k in (10, 20, 50)})
stages("f15_cci", ft.cci, {"tp": "(h + l + c) / 3"}, {f"x{k}": f"list(tp) {over(k)}" for k in (14, 20)} | {f"m{k}": roll("avg", "tp", k) for k in (14, 20)}, {f"price_cci_{k}": f"(tp - m{k}) / (0.015 * list_avg(list_transform(x{k}, lambda y: abs(y - m{k}))) + {E})" for k in (14, 20)})
stages("f16_williams", ft.williams, {f"price_williams_r_{k}": f"-100 * ({roll('max', 'h', k)} - c) / ({roll('max', 'h', k)} - {roll('min', 'l', k)} + {E})" for k in (14, 28)})
_vol = ({"vr": f"v / ({roll('avg', 'v', 20)} + {E})", "v5": roll("avg", "v", 5), "dc": f"sign(c - {lag('c')}) * v", "pv": "(h + l + c) / 3 * v"}, {"tr5": f"v5 - {lag('v5')}", "obv": f"case when dc is not null then sum(dc) {_exp} end", "vw": f"{roll('sum', 'pv', 6)} / ({roll('sum', 'v', 6)} + {E})"})
stages("f17_volume_ratio", ft.volume, *_vol, {"price_volume_sma_20_ratio": "vr", "price_volume_trend_5": "tr5"})
stages("f18_obv", ft.volume, *_vol, {"price_obv": "obv", "price_obv_slope": f"obv - {lag('obv', 5)}"})
stages("f19_vwap", ft.volume, *_vol, {"price_vwap_6c": "vw", "price_vwap_dist": div("c - vw", "vw")})
stages("f20_taker", ft.taker, {"r": div("tb", "v")}, {"price_taker_buy_zscore": zscore("r", 42)})
stages("f21_swings", ft.swings, {"hh": flagged(f"h > {lag('h')}"), "ll": flagged(f"l < {lag('l')}")}, {f"price_{a}_count_{k}": roll("sum", a, k) for a in ("hh", "ll") for k in (20, 50)} | {f"price_hh_ll_diff_{k}": f"{roll('sum', 'hh', k)} - {roll('sum', 'll', k)}" for k in (20, 50)})
_span = lambda k: f"({roll('max', 'h', k)} - {roll('min', 'l', k)})"
stages("f22_consolidation", ft.consolidation, {f"price_consolidation_{k}": div(_span(k), _span(2 * k)) for k in (20, 50)})

# source features, on columns of the bars in synthetic roles
_m, _s = roll("avg", "o", 42), roll("stddev_samp", "o", 42)
stages("f23_funding", lambda: ft.funding("o"), {f"o_zscore_{k}h": zscore("o", k) for k in (168, 336, 720)} | {f"o_cumul_{k}h": roll("sum", "o", k) for k in (8, 24, 72, 168)} | {"o_extreme_pos": flagged(f"o > {_m} + 2 * {_s}"), "o_extreme_neg": flagged(f"o < {_m} - 2 * {_s}")})
_oi = {f"n_change_{k}h": f"{div('n', lag('n', k))} - 1" for k in (1, 4, 24, 168)} | {f"n_zscore_{k}h": zscore("n", k) for k in (168, 720)}
stages("f24_open_interest", lambda: ft.open_interest("n"), _oi | {"step": f"n - {lag('n')}"}, {k: k for k in _oi} | {"n_accel": f"step - {lag('step')}", "n_flush": flagged("n_change_4h < -0.05")})
_m, _s = roll("avg", "v", 42), roll("stddev_samp", "v", 42)
stages("f25_liquidation", lambda: ft.liquidation("v"), {f"v_{a}_{k}h": roll(a, "v", k) for a in ("sum", "max") for k in (24, 168)} | {"v_spike": flagged(f"v > {_m} + 3 * {_s}")})
stages("f26_long_short", lambda: ft.long_short("h"), {f"h_zscore_{k}h": zscore("h", k) for k in (168, 336)} | {"h_extreme_long": flagged(f"h > {roll('quantile_cont({}, 0.95)', 'h', 42)}"), "h_extreme_short": flagged(f"h < {roll('quantile_cont({}, 0.05)', 'h', 42)}")})
stages("f27_vix", lambda: ft.vix("c"), {"c_regime_low": flagged("c < 15"), "c_regime_normal": flagged("c >= 15 and c < 20"), "c_regime_elevated": flagged("c >= 20 and c < 30"), "c_regime_extreme": flagged("c >= 30")} | {f"c_zscore_{k}d": zscore("c", k) for k in (30, 90, 252)} | {"c_spike": flagged(f"{div('c', lag('c'))} - 1 > 0.2")})
stages("f28_curve", lambda: ft.curve("y"), {"y": "c - 150000"}, {"y_inverted": flagged("y < 0")} | {f"y_change_{k}d": f"y - {lag('y', k)}" for k in (5, 20, 60)}, source=lambda s, d: ft.apply(daily(s, d), {"y": F.col("c") - 150000}), head=DAILY)
stages("f29_dollar", lambda: ft.dollar("c"), {"c_vs_sma50": f"{div('c', roll('avg', 'c', 50))} - 1"} | {f"c_change_{k}d": f"{div('c', lag('c', k))} - 1" for k in (1, 5, 20)}, source=daily, head=DAILY)
stages("f30_conditions", lambda: ft.conditions("y"), {"y": "(c - 150000) / 1e5"}, {"y_tight": flagged("y > 0"), "y_loose": flagged("y < 0"), "y_change_5d": f"y - {lag('y', 5)}"}, source=lambda s, d: ft.apply(daily(s, d), {"y": (F.col("c") - 150000) / 1e5}), head=DAILY)
_ext = flagged("c < 20 or c > 80")
_fg = {"c_extreme_fear": "c < 20", "c_fear": "c >= 20 and c < 40", "c_neutral": "c >= 40 and c < 60", "c_greed": "c >= 60 and c < 80", "c_extreme_greed": "c >= 80"}
_fgs = {k: flagged(e) for k, e in _fg.items()} | {f"c_zscore_{k}d": zscore("c", k) for k in (30, 90)} | {"c_change_7d": f"c - {lag('c', 7)}"}
stages("f31_fear_greed", lambda: ft.fear_greed("c"), _fgs | {"ext": _ext}, {"calm": f"sum(1 - ext) {_exp}"}, {k: k for k in _fgs} | {"c_days_at_extreme": "sum(ext) over (partition by sym, calm order by t rows unbounded preceding)"})
stages("f32_implied_vol", lambda: ft.implied("l"), {f"l_zscore_{k}d": zscore("l", k) for k in (30, 90)})
_dt = "to_timestamp(t) at time zone 'UTC'"
_hr, _dw, _mo = "((t % 86400) // 3600)", f"(isodow({_dt}) - 1)", f"month({_dt})"
_cal = {"time_hour": _hr, "time_dow": _dw, "time_dom": f"day({_dt})", "time_week": f"week({_dt})", "time_month": _mo}
_cal |= {f"time_{n}_{f}": f"{f}(2 * pi() * {x} / {p})" for n, x, p in (("hour", _hr, 24), ("dow", _dw, 7), ("month", _mo, 12)) for f in ("sin", "cos")}
_cal |= {"time_weekend": flagged(f"{_dw} >= 5"), "time_month_end": flagged(f"day({_dt}) >= 28"), "time_asia": flagged(f"{_hr} < 8"), "time_europe": flagged(f"{_hr} >= 7 and {_hr} < 16"), "time_us": flagged(f"{_hr} >= 13 and {_hr} < 21"), "time_us_open": flagged(f"{_hr} >= 14 and {_hr} < 21 and {_dw} < 5")}
stages("f33_calendar", ft.calendar, _cal)

# recursive families
_emas = [f"e{p}" for p in (6, 8, 12, 13, 21)]
R.add("f05_ema", recursive(", ".join(f"c as n{p}, 1.0::double as d{p}" for p in (6, 21)), ", ".join(f"r.n{p} * {1 - 2 / (p + 1)} + n.c, r.d{p} * {1 - 2 / (p + 1)} + 1" for p in (6, 21)), "n6 / d6", "price_ema_6, round(n21 / d21, 6) as price_ema_21, round(c / nullif(n21 / d21, 0) - 1, 6) as price_vs_ema_21"))(
    lambda s, d: shown(ft.ema_features(bars4h(s, d)), "price_ema_6", "price_ema_21", "price_vs_ema_21")
)
_five = (6, 8, 12, 13, 21)
R.add("f07_ema_alignment", recursive(", ".join(f"c as n{p}, 1.0::double as d{p}" for p in _five), ", ".join(f"r.n{p} * {1 - 2 / (p + 1)} + n.c, r.d{p} * {1 - 2 / (p + 1)} + 1" for p in _five), f"(case when i = 1 then 1 when {' and '.join(f'n{a}/d{a} <= n{b}/d{b}' for a, b in zip(_five, _five[1:], strict=False))} then 1 when {' and '.join(f'n{a}/d{a} >= n{b}/d{b}' for a, b in zip(_five, _five[1:], strict=False))} then -1 else 0 end)::double", "price_ema_alignment"))(
    lambda s, d: shown(ft.ema_features(bars4h(s, d), _five), "price_ema_alignment")
)
_up, _down, _ra = "greatest(n.c - r.c, 0)", "greatest(r.c - n.c, 0)", 2 / 15
R.add("f11_rsi", recursive("0.0::double as g, 0.0::double as s", f"r.g * {1 - _ra} + {_ra} * {_up}, r.s * {1 - _ra} + {_ra} * {_down}", "100 - 100 / (1 + g / (s + 1e-10))", "price_rsi_14, (100 - 100 / (1 + g / (s + 1e-10)) < 30)::int::double as price_rsi_14_oversold"))(
    lambda s, d: shown(ft.rsi(bars4h(s, d)), "price_rsi_14", "price_rsi_14_oversold")
)
R.add("f11_rsi_stretches", R.sql["f11_rsi"])(lambda s, d: shown(st.rsi(bars4h(s, d)), "price_rsi_14", "price_rsi_14_oversold"))
R.add("f18_obv_stretches", R.sql["f18_obv"])(lambda s, d: shown(ft.apply(st.obv(bars4h(s, d)), {"price_obv_slope": S.diff("price_obv", 5)}), "price_obv", "price_obv_slope"))
_k = {12: 1 - 2 / 13, 26: 1 - 2 / 27, 9: 1 - 2 / 10}
_line = f"((r.n12 * {_k[12]} + n.c) / (r.d12 * {_k[12]} + 1) - (r.n26 * {_k[26]} + n.c) / (r.d26 * {_k[26]} + 1))"
R.add("f13_macd", recursive("c as n12, 1.0::double as d12, c as n26, 1.0::double as d26, 0.0::double as line, 0.0::double as n9, 1.0::double as d9", f"r.n12 * {_k[12]} + n.c, r.d12 * {_k[12]} + 1, r.n26 * {_k[26]} + n.c, r.d26 * {_k[26]} + 1, {_line}, r.n9 * {_k[9]} + {_line}, r.d9 * {_k[9]} + 1", "line", "price_macd_line, round(n9 / d9, 6) as price_macd_signal, round(line - n9 / d9, 6) as price_macd_histogram"))(
    lambda s, d: shown(ft.macd(bars4h(s, d)), "price_macd_line", "price_macd_signal", "price_macd_histogram")
)

# interactions, lags, shift, simple targets
_l6, _l48 = (lambda x: lag(x, 6)), (lambda x: lag(x, 48))
_falls = lambda x: f"{x} < {_l6(x)} and {_l6(x)} < {_l48(x)}"
_rises = lambda x: f"{x} > {_l6(x)} and {_l6(x)} > {_l48(x)}"
_turns_up = lambda x: f"{x} > {_l6(x)} and {_l6(x)} < {_l48(x)}"
_turns_down = lambda x: f"{x} < {_l6(x)} and {_l6(x)} > {_l48(x)}"
stages("f34_divergences", lambda: [{"rsi": S.mean("v", 6)}, *ft.divergences(["rsi"])], {"rsi": roll("avg", "v", 6)}, {"rsi_bear_div": flagged(f"{_rises('h')} and {_turns_down('rsi')}"), "rsi_bull_div": flagged(f"{_falls('l')} and {_turns_up('rsi')}")})
stages("f35_oi_price", lambda: [{"a": S.pct_change("n"), "b": S.pct_change("c", 6)}, *ft.oi_price("a", "b", "o")], {"a": f"{div('n', lag('n'))} - 1", "b": f"{div('c', lag('c', 6))} - 1", "top": f"{roll('avg', 'o', 42)} + {roll('stddev_samp', 'o', 42)}"}, {"oi_price_div": flagged("a > 0 and b < 0"), "oi_price_squeeze": flagged("a < 0 and b > 0"), "funding_price_div": flagged("o > top and b < 0")})
_os, _ob = flagged("c < 30 and vr > 2"), flagged("c > 70 and vr > 2")
stages("f36_crowding", lambda: [{"r1": F.col("c"), "r1_oversold": flag(F.col("c") < 30), "r1_overbought": flag(F.col("c") > 70), "r2_oversold": flag(F.col("o") < 30), "r2_overbought": flag(F.col("o") > 70), "vr": S.mean("v", 3) / 6}, *ft.crowding("r1", ["r1", "r2"], "vr")], {"vr": f"{roll('avg', 'v', 3)} / 6"}, {"rsi_oversold_vol_spike": _os, "rsi_overbought_vol_spike": _ob, "multi_oversold": f"{flagged('c < 30')} + {flagged('o < 30')} + {_os}", "multi_overbought": f"{flagged('c > 70')} + {flagged('o > 70')} + {_ob}"})
stages("f37_lags", lambda: ft.lags(["c", "v"]), {f"{x}_lag_{k}h": lag(x, k) for x in ("c", "v") for k in (4, 24, 48)})
_lq = {f"liq_feat_v_lag_{4 * k}h": lag("v", k) for k in (1, 3, 6, 12, 24)}


def _family(s, d):
    """The whole price family with the lags of its key columns."""
    df = ft.all_price(bars4h(s, d))
    return ft.apply(df, *ft.lags(ft.lagged_columns(df.columns)))


_bp = lambda k: div(f"c - ({roll('avg', 'c', k)} - 2 * {roll('stddev_samp', 'c', k)})", f"4 * {roll('stddev_samp', 'c', k)}")
_fam = {"z": zscore("c", 168), "b20": _bp(20), "b50": _bp(50), "r20": f"v / ({roll('avg', 'v', 20)} + {E})"}
_fam_out = {f"price_zscore_168h_lag_{k}h": lag("z", k) for k in (4, 24, 48)} | {f"price_bb_position_{b}_lag_{k}h": lag(f"b{b}", k) for b in (20, 50) for k in (4, 24, 48)} | {"price_volume_sma_20_ratio": "r20"}
R.add("f37_price_family", staged(_fam, _fam_out))(lambda s, d: shown(_family(s, d), *_fam_out))
stages("f38_liquidation_lags", lambda: ft.liquidation_lags("v"), _lq | {"lx": lag("v")}, {k: k for k in _lq} | {f"liq_feat_v_{a}_{4 * k}h": roll(f, "lx", k, 1) for k in (6, 12, 24, 42) for a, f in (("sum", "sum"), ("mean", "avg"), ("max", "max"))} | {f"liq_feat_v_zscore_{4 * k}h": f"(lx - {roll('avg', 'lx', k, 10)}) / ({roll('stddev_samp', 'lx', k, 10)} + {E})" for k in (24, 42, 84)} | {f"liq_feat_v_mom_{4 * k}h": f"lx - {lag('lx', k)}" for k in (1, 3, 6)})
R.add("f39_shift", staged({"x": lag("c"), "y": "c", "rn": f"row_number() over ({P})"}, {"x": "x", "y": "y"}) + " where rn > 1")(lambda s, d: shown(ft.shifted(ft.apply(bars4h(s, d), {"x": F.col("c"), "y": F.col("c")}), ["x"]), "x", "y"))
_tg = {f"target_return_{k}h": f"{div(lead('c', k), 'c')} - 1" for k in (1, 4, 8, 24, 48, 168)}
stages("f40_simple_targets", ft.simple_targets, _tg, {k: k for k in _tg} | {f"target_profitable_{k}h": flagged(f"target_return_{k}h > 0.0006") for k in (1, 24)} | {f"target_direction_{k}h": f"case when target_return_{k}h > 0.01 then 1 when target_return_{k}h < -0.01 then -1 else 0 end" for k in (1, 24)})
stages("fm1_products", lambda: ft.products(["o", "n"], ["v"]), {"o_x_v": "o * v", "n_x_v": "n * v"})
stages("fm2_momentum", lambda: ft.momentum(["v"]), {"m1": f"v - {lag('v')}"}, {"v_mom1": "m1", "v_mom3": f"v - {lag('v', 3)}", "v_mom_acc": f"m1 - {lag('m1')}"})
_rp = "(len(list_filter(xs, lambda y: y < c)) + (len(list_filter(xs, lambda y: y = c)) + 1) / 2.0) / len(xs)"
stages("fm3_regimes", lambda: ft.regimes("c"), {"xs": f"list(c) {over(50)}"}, {"rp": f"case when len(xs) >= 10 then {_rp} end"}, {"c_high": flagged("rp > 0.8"), "c_low": flagged("rp < 0.2"), "c_extreme": flagged("rp > 0.9")})
stages("fm4_short_z", lambda: ft.short_z(["v"]), {f"v_z{k}": f"(v - {roll('avg', 'v', k, m)}) / ({roll('stddev_samp', 'v', k, m)} + {E})" for k, m in ((20, 5), (50, 10))})
stages("fm5_crowded", lambda: [{"fz": S.zscore("o", 24), "fs": S.roll(F.sum, "o", 8), "oi": S.pct_change("n"), "oj": S.pct_change("n", 4)}, *ft.crowded(["fz", "fs", "x"], ["oi", "oj"])], {"fz": zscore("o", 24), "fs": roll("sum", "o", 8), "oi": f"{div('n', lag('n'))} - 1", "oj": f"{div('n', lag('n', 4))} - 1"}, {"crowded_0": "fz * oi", "crowded_1": "fz * oj", "crowded_2": "fs * oi", "crowded_3": "fs * oj"})
stages("p12_clip", lambda: [{"x": clip(F.col("c"), 10, 90)}], {"x": "least(greatest(c, 10), 90)"})
stages("a16_row_wise", lambda: [{"nn": F.when(F.col("c") > 50, F.col("c"))}, {"s": row_sum(F.col("o"), F.col("nn")), "m": row_mean(F.col("o"), F.col("nn")), "g": F.greatest("o", "nn")}], {"nn": "case when c > 50 then c end"}, {"s": "o + coalesce(nn, 0)", "m": "(o + coalesce(nn, 0)) / (1 + (nn is not null)::int)", "g": "greatest(o, nn)"})
