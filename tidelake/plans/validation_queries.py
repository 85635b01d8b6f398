"""Validation as queries, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import stats
from tidelake.functions.sqlkit import BARS, P, lag
from tidelake.operators import search as rs
from tidelake.operators import validation as vd
from tidelake.operators.features import apply

from .base import Registry, bars4h
from .metric_queries import _T, signals, trades
from .rule_queries import _GREEDY, _RET, _fired, _with_ret

R = Registry()


def _rounded(df, exact: list[str], digits: dict[str, int]):
    return df.select(*exact, *[F.round(c, n).alias(c) for c, n in digits.items()])


def _integral(density: str, upper: str, steps: int = 400) -> str:
    """Simpson's rule from 0 to ``upper``; ``density`` is in @."""
    f = density.replace("@", f"(({upper}) * i / {steps}.0)")
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: (case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end) * ({f}))) * ({upper}) / {steps * 3}.0)"


def _t_two_sided(t: str, n: str) -> str:
    v = f"({n} - 1.0)"
    scale = f"(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - 0.5 * ln({v} * pi()))"
    return f"(1 - 2 * {_integral(f'pow(1 + @ * @ / {v}, -({v} + 1) / 2)', f'abs({t})')} * exp({scale}))"


def _normal_two_sided(z: str) -> str:
    return f"(1 - 2 * {_integral('exp(-@ * @ / 2)', f'abs({z})')} / sqrt(2 * pi()))"


_STATS = f"""with {_T}, mid as (select sym, median(r) as mid from tr group by 1), u as (select tr.*, (r > mid)::int as up from tr join mid using (sym)),
w as (select *, {lag('r')} as prev, {lag('up')} as was from u), a as (select sym, avg(r) as mu, stddev_pop(r) as sd from tr group by 1),
g as (select sym, count(*) as n, avg(r) as mean, stddev_samp(r) as std, avg(pow((r - mu) / sd, 3)) as skew, avg(pow((r - mu) / sd, 4)) - 3 as kurt, corr(r, prev) as autocorr,
  coalesce(sum((sign(r) <> sign(prev))::int), 0)::bigint + 1 as runs, coalesce(sum((up <> was)::int), 0)::bigint + 1 as median_runs, sum(up)::double as a from w join a using (sym) group by 1),
h as (select *, mean / (std / sqrt(n)) as t, 2 * a * (n - a) as two, n * (n + 2) * autocorr * autocorr / (n - 1) as lb from g),
k as (select *, (median_runs - (1 + two / n)) / (sqrt(greatest(two * (two - n) / (n * n * (n - 1.0)), 0)) + 1e-8) as z from h)"""
R.add("m12_pvalues", f"{_STATS} select sym, n, round(skew, 5) as skew, round(kurt, 5) as kurt, round(autocorr, 6) as autocorr, runs, median_runs, round({_t_two_sided('t', 'n')}, 5) as p, round(exp(-(n / 6.0 * (skew * skew + kurt * kurt / 4)) / 2), 6) as moments_p, round({_normal_two_sided('sqrt(lb)')}, 5) as ljung_p, round({_normal_two_sided('z')}, 5) as runs_p from k")(
    lambda s, d: _rounded(rs.statistics(trades(s, d)), ["sym", "n", "runs", "median_runs"], {"skew": 5, "kurt": 5, "autocorr": 6, "p": 5, "moments_p": 6, "ljung_p": 5, "runs_p": 5})
)

# A rational approximation of the normal quantile (relative error 1e-9), for the check only.
_Q = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def _horner(cs, x: str) -> str:
    out = str(cs[0])
    for c in cs[1:]:
        out = f"({out}) * {x} + {c}"
    return f"({out})"


def _normal_quantile(p: str) -> str:
    tail = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    mid = f"(({p}) - 0.5)"
    return f"case when least({p}, 1 - {p}) < 0.02425 then sign(0.5 - {p}) * {_horner(_Q[2], tail)} / {_horner(_Q[3], tail)} else {mid} * {_horner(_Q[0], f'({mid} * {mid})')} / {_horner(_Q[1], f'({mid} * {mid})')} end"


def _series(cs, x: str) -> str:
    return " + ".join(f"{c} * pow({x}, {k})" for k, c in enumerate(cs))


#: For series of 12 to 1,000 values, which are tested whole.
_SHAPIRO = f"""with {_T}, v as (select sym, r, row_number() over (partition by sym order by r) as i, count(*) over (partition by sym) as n from tr),
ms as (select *, {_normal_quantile('((i - 0.375) / (n + 0.25))')} as m from v),
ks as (select sym, any_value(n) as n, sum(m * m) as ss, max(case when i = n then m end) as m1, max(case when i = n - 1 then m end) as m2, 1 / sqrt(any_value(n)) as u, avg(r) as mu, sum(r * r) - count(*) * avg(r) * avg(r) as spread from ms group by 1),
ws as (select *, m1 / sqrt(ss) + {_series(stats._LARGEST, 'u')} as a1, m2 / sqrt(ss) + {_series(stats._SECOND, 'u')} as a2 from ks),
p as (select *, (ss - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) as phi from ws),
sw as (select sym, any_value(p.n) as n, pow(sum(r * case when i = p.n then a1 when i = 1 then -a1 when i = p.n - 1 then a2 when i = 2 then -a2 else m / sqrt(phi) end), 2) / any_value(spread) as w from ms join p using (sym) group by 1),
z as (select *, (ln(1 - w) - ({_series(stats._MANY_MEAN, 'ln(n)')})) / exp({_series(stats._MANY_LOG_SD, 'ln(n)')}) as z from sw)
select sym, n, round(w, 6) as w, round(greatest(case when z > 0 then {_normal_two_sided('z')} / 2 else 1 - {_normal_two_sided('z')} / 2 end, 0), 4) as p from z"""


@R.add("m12_normality", _SHAPIRO)
def _(s, d):
    x = rs.statistics(trades(s, d))
    return x.select("sym", "n", F.round("normal_w", 6).alias("w"), F.round("normal_p", 4).alias("p"))


_SH = lambda r, days: f"coalesce(case when count({r}) >= 5 and stddev_samp({r}) > 0 then avg({r}) / stddev_samp({r}) * sqrt(count({r}) / ({days}) * 365) end, 0)"
_POINTS = """case when sharpe >= 2 then 40 when sharpe >= 1.5 then 35 when sharpe >= 1 then 25 when sharpe >= 0.5 then 15 when sharpe > 0 then 5 else 0 end
 + case when win_rate >= 0.55 then 15 when win_rate >= 0.52 then 10 when win_rate >= 0.5 then 5 else 0 end
 + case when max_drawdown > -0.1 then 15 when max_drawdown > -0.15 then 12 when max_drawdown > -0.2 then 8 when max_drawdown > -0.3 then 4 else 0 end
 + case when p < 0.05 then 15 when p < 0.1 then 8 else 0 end + floor(15 * robust)"""
_GRADE = f"""with {_T}, e as (select sym, t, r, days, product(1 + r) over ({P} rows unbounded preceding) as equity, row_number() over ({P}) - 1 as i, count(*) over (partition by sym) as cnt from j),
w as (select *, equity / greatest(max(equity) over ({P} rows unbounded preceding), 1.0) - 1 as drawdown, case when i < cnt // 2 then r end as r1, case when i >= cnt // 2 then r end as r2 from e),
g as (select sym, count(r) as n, {_SH('r', 'any_value(days)')} as sharpe, avg((r > 0)::int) as win_rate, min(drawdown) as max_drawdown, avg(r) / (stddev_samp(r) / sqrt(count(r))) as t, {_SH('r1', 'any_value(days) / 2')} as s1, {_SH('r2', 'any_value(days) / 2')} as s2 from w group by 1),
k as (select *, {_t_two_sided('t', 'n')} as p2, case when s1 <> 0 then greatest(0, 1 - abs(s2 - s1) / (abs(s1) + 1e-8)) else 0.5 end as robust from g),
x as (select *, case when t > 0 then p2 / 2 else 1 - p2 / 2 end as p from k), y as (select *, {_POINTS} as points from x)
select sym, n, round(sharpe, 4) as sharpe, round(win_rate, 6) as win_rate, round(max_drawdown, 6) as max_drawdown, round(p, 5) as p, round(robust, 5) as robust,
  case when sharpe > 10 then 'F' when points >= 85 then 'A' when points >= 70 then 'B' when points >= 55 then 'C' when points >= 40 then 'D' else 'F' end as grade from y"""
R.add("m14_grade", _GRADE)(lambda s, d: _rounded(vd.graded(trades(s, d)), ["sym", "n", "grade"], {"sharpe": 4, "win_rate": 6, "max_drawdown": 6, "p": 5, "robust": 5}))

_MC = lambda x: f"case when count({x}) >= 2 then avg({x}) / (coalesce(stddev_samp({x}), 0) + 1e-8) * sqrt(count({x}) / 90.0 * 365) else 0 end"
_RANDOM = f"""with {_T}, z as (select sym, t, ret, case when sig * ret <> 0 then sig * ret end as own from s where ret is not null),
a as (select sym, count(own) as n_trades, count(own) / count(*) as rate, {_MC('own')} as sa, product(1 + coalesce(own, 0)) - 1 as ta from z group by 1),
q as (select sym, run, rate, ret, (('0x' || substr(md5('42|' || run || '|' || sym || '|' || t), 1, 8))::bigint) / 4294967296.0 as u from z join a using (sym), (select unnest(range(0, 1000)) as run)),
v as (select sym, run, case when u < rate / 2 then -ret when u < rate then ret else 0 end as r from q),
m as (select sym, run, {_MC('(case when r <> 0 then r end)')} as sharpe, product(1 + r) - 1 as total from v group by 1, 2),
o as (select sym, any_value(n_trades) as n_trades, any_value(sa) as sa, any_value(ta) as ta, avg((sharpe < sa)::int) * 100 as sp, avg((total < ta)::int) * 100 as tp, avg(sharpe) as rm, stddev_pop(sharpe) as rs, count(*) as runs from m join a using (sym) group by 1)
select sym, n_trades, round(sa, 4) as actual_sharpe, round(ta, 6) as actual_total, round(sp, 1) as sharpe_percentile, round(tp, 1) as total_percentile, round(rm, 4) as random_mean, round(rs, 4) as random_std, runs, sp > 95 as better_than_random from o where n_trades >= 5"""
R.add("m15_monte_carlo", _RANDOM)(lambda s, d: _rounded(vd.monte_carlo(signals(s, d)).where("n_trades >= 5"), ["sym", "n_trades", "runs", "better_than_random"], {"actual_sharpe": 4, "actual_total": 6, "sharpe_percentile": 1, "total_percentile": 1, "random_mean": 4, "random_std": 4}))


def _strategy(s, d):
    return apply(signals(s, d), {"vol": F.col("h") - F.col("l"), "trend": F.col("c") - F.lag("c", 6).over(vd.S.o)})


R.add("m16_validate", None)(lambda s, d: vd.validate(_strategy(s, d), vol="vol", trend="trend", min_test=10).drop("regimes"))
# the whole of each strategy by plain SQL: one trade in six bars at most, costs, every figure but the tests
_WHOLE = f"""with recursive {_T}, z as (select sym, t, ret, sig, row_number() over ({P}) as i from s where ret is not null),
k as (select sym, i, t, ret, sig, sig <> 0 as keep, case when sig <> 0 then i + 6 else 0 end as free from z where i = 1
  union all select z.sym, z.i, z.t, z.ret, z.sig, z.sig <> 0 and z.i >= k.free, case when z.sig <> 0 and z.i >= k.free then z.i + 6 else k.free end from z join k on z.sym = k.sym and z.i = k.i + 1),
b as (select sym, t, keep, case when keep then sig * ret - 0.0012 else 0 end as r from k), e as (select *, product(1 + r) over ({P} rows unbounded preceding) as eq from b),
w as (select *, eq / max(eq) over ({P} rows unbounded preceding) - 1 as dd, case when keep then r end as x from e),
q as (select sym, quantile_cont(r, 0.05) as var_95, greatest(1, floor(count(*) / 6.0)) as days from b group by 1),
g as (select sym, count(x) as n_trades, product(1 + r) - 1 as total, avg(x) / stddev_samp(x) * sqrt(count(x) / any_value(days) * 365) as sharpe, avg(x) / stddev_samp(case when x < 0 then x end) * sqrt(count(x) / any_value(days) * 365) as sortino,
  min(dd) as max_drawdown, avg((x > 0)::int) as win_rate, avg(x) filter (where x > 0) as avg_win, avg(x) filter (where x < 0) as avg_loss, sum(x) filter (where x > 0) / (abs(sum(x) filter (where x < 0)) + 1e-8) as profit_factor,
  any_value(var_95) as var_95, avg(r) filter (where r <= var_95) as expected_shortfall, avg(r) / (stddev_samp(r) / sqrt(count(*))) as t_stat, count(*) as bars from w join q using (sym) group by 1),
y as (select *, pow(1 + total, 365 / (bars / 6.0)) - 1 as annual, {_t_two_sided('t_stat', 'bars')} / 2 as p from g)
select sym, n_trades, round(total, 6) as total_return, round(annual, 5) as annualized_return, round(sharpe, 4) as sharpe, round(sortino, 4) as sortino, round(max_drawdown, 6) as max_drawdown, round(win_rate, 6) as win_rate, round(avg_win, 8) as avg_win, round(avg_loss, 8) as avg_loss,
  round(profit_factor, 5) as profit_factor, round(var_95, 8) as var_95, round(expected_shortfall, 8) as expected_shortfall, round(annual / (abs(max_drawdown) + 1e-8), 3) as calmar, round(t_stat, 5) as t_stat, round(p, 5) as p_value from y"""
R.add("m09_full_metrics", _WHOLE)(
    lambda s, d: _rounded(
        vd.full_metrics(vd.views(signals(s, d), min_test=10).where("view = 'whole'"), ["sym", "view"]),
        ["sym", "n_trades"],
        {"total_return": 6, "annualized_return": 5, "sharpe": 4, "sortino": 4, "max_drawdown": 6, "win_rate": 6, "avg_win": 8, "avg_loss": 8, "profit_factor": 5, "var_95": 8, "expected_shortfall": 8, "calmar": 3, "t_stat": 5, "p_value": 5},
    )
)

_LIMITS = {"is_trades": 5, "is_sharpe": 0.1, "oos_trades": 3}
_CFG = [("pct_70", "quantile_cont(value, 0.7)"), ("pct_80", "quantile_cont(value, 0.8)"), ("pct_90", "quantile_cont(value, 0.9)"), ("z_1.5", "avg(value) + 1.5 * stddev_samp(value)"), ("z_2", "avg(value) + 2 * stddev_samp(value)")]
_FITTED = " union all ".join(f"select sym, indicator, '{c}' as config, {e} as th from lg where not oos group by 1, 2" for c, e in _CFG)
_CAP = lambda r: f"coalesce(case when count({r}) >= 2 and stddev_samp({r}) > 0 then avg({r}) / stddev_samp({r}) * sqrt(least(count({r}), 2190)) end, 0)"
_OOS = f"""with recursive {BARS}, n as (select sym, t, c - 50 as cc, o - 50 as oo, {_RET} as ret, row_number() over ({P}) - 1 as i, count(*) over (partition by sym) as cnt from bars),
lg as (select sym, t, i, i >= floor(cnt * 0.7::double) as oos, ret, indicator, value from (unpivot (select sym, t, i, cnt, coalesce(ret, -999) as ret, cc, oo from n) on cc, oo into name indicator value value)),
ft as ({_FITTED}),
hit as (select * from (select lg.*, config, case when value < -th then case when th > 0 then -1 else 0 end when value > th then 1 else 0 end as side from lg join ft using (sym, indicator)) where side <> 0),
j as (select *, row_number() over (partition by sym, indicator, config, oos order by i) as jj from hit),
k as (select sym, indicator, config, oos, jj, side, ret, true as keep, i + 6 as free from j where jj = 1 union all select j.sym, j.indicator, j.config, j.oos, j.jj, j.side, j.ret, j.i >= k.free, case when j.i >= k.free then j.i + 6 else k.free end from j join k on j.sym = k.sym and j.indicator = k.indicator and j.config = k.config and j.oos = k.oos and j.jj = k.jj + 1),
tr as (select sym, indicator, config, oos, dir as direction, side * dir * nullif(ret, -999) as r from k, (select unnest([1, -1]) as dir) where keep),
g as (select sym, indicator, config, direction, count(*) filter (where not oos) as is_n, {_CAP('(case when not oos then r end)')} as is_sharpe, count(*) filter (where oos) as oos_n, {_CAP('(case when oos then r end)')} as oos_sharpe from tr group by 1, 2, 3, 4),
w as (select *, oos_sharpe / is_sharpe as retention from g where is_n >= 5 and is_sharpe >= 0.1)
select sym, indicator, config, direction, is_n, round(is_sharpe, 5) as is_sharpe, oos_n, round(oos_sharpe, 5) as oos_sharpe, round(retention, 5) as retention,
  case when oos_n < 3 then 'INSUFFICIENT_DATA' when oos_sharpe < 0.5 or retention < 0.3 then 'OVERFIT' when retention >= 0.6 then 'CREDIBLE' else 'MARGINAL' end as verdict from w"""
R.add("r26_oos_search", _OOS)(lambda s, d: _rounded(vd.oos_search(apply(_with_ret(s, d), {"cc": F.col("c") - 50, "oo": F.col("o") - 50}), ["cc", "oo"], limits=_LIMITS), ["sym", "indicator", "config", "direction", "is_n", "oos_n", "verdict"], {"is_sharpe": 5, "oos_sharpe": 5, "retention": 5}))


def _exit_frame(s, d):
    b = apply(bars4h(s, d), {"rsi_14": F.col("o"), "bb_position": (F.col("c") - F.col("l")) / (F.col("h") - F.col("l") + 1e-9) * 1.5 - 0.2, "macd_histogram": F.col("c") - vd.S.lag("c"), "entry": vd.S.row() % 7 == 0})
    return apply(b, {"ret": (F.try_divide(vd.S.lead("c", 6), F.col("c")) - 1) / 1000})


_EXIT_SQL = {"overbought": "b.rsi_14 > 70", "oversold": "b.rsi_14 < 30", "macd_bearish": "b.macd < 0", "macd_bullish": "b.macd > 0", "bb_upper": "b.bb > 1", "bb_lower": "b.bb < 0"}
_EXIT_ROWS = " union all ".join(f"select '{k}' as exit, a.sym, a.t, a.i, a.c, a.last, min(b.i - a.i) filter (where {e}) as first_at from n a left join n b on a.sym = b.sym and b.i between a.i + 1 and a.i + 12 where a.i % 7 = 0 group by all" for k, e in _EXIT_SQL.items())
_EXITS = f"""with {BARS}, n as (select sym, t, c, o as rsi_14, (c - l) / (h - l + 1e-9) * 1.5 - 0.2 as bb, c - {lag('c')} as macd, row_number() over ({P}) as i, count(*) over (partition by sym) as last from bars),
x as ({_EXIT_ROWS}), y as (select *, case when first_at is not null then first_at when i + 12 <= last then 12 end as bars from x),
z as (select y.sym, exit, bars, first_at, e.c / nullif(y.c, 0) - 1 as r from y join n e on e.sym = y.sym and e.i = y.i + bars)
select sym, exit, count(*) as n, round(avg(r), 6) as mean_return, round(avg(bars), 6) as mean_bars, round(count(first_at) / count(*), 6) as hit_rate from z group by 1, 2 having count(*) >= 4"""
R.add("r18_conditional_exits", _EXITS)(lambda s, d: _rounded(vd.conditional_exits(_exit_frame(s, d), "entry", most=12, min_trades=8), ["sym", "exit", "n"], {"mean_return": 6, "mean_bars": 6, "hit_rate": 6}))
_USAGE = f"""with recursive {BARS}, {_fired('o, h, l, c, v')}, {_GREEDY}, g as (select sym, indicator, op, pct, count(*) as support, avg((ret > 0)::int) as win from k where keep group by 1, 2, 3, 4 having count(*) >= 10),
b as (select *, case when win >= 0.5 then win else 1 - win end as confidence from g order by confidence desc, support desc, sym, indicator, op, pct limit 10)
select indicator, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from b group by 1"""
R.add("r18_feature_usage", _USAGE)(lambda s, d: _rounded(vd.feature_usage(rs.mine(_with_ret(s, d), ["o", "h", "l", "c", "v"], min_trades=10, min_win=0.5)), ["indicator", "n"], {"share": 6}))
R.add("r18_complete_strategy", None)(lambda s, d: vd.complete_strategy(_exit_frame(s, d).drop("entry"), ["c", "v"], min_trades=10)["exits"])
