"""Signals, rule search, anti-patterns, the critic and learning as queries, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import stats
from tidelake.functions.sqlkit import BARS, P, div, lag, lead, roll, staged
from tidelake.functions.windows import flag
from tidelake.operators import backtest as bt
from tidelake.operators import metrics as m
from tidelake.operators import search as rs
from tidelake.operators.features import apply
from tidelake.operators.rowops import Condition, Rule

from .base import Registry, bars4h, shown
from .metric_queries import trades

R = Registry()
_RET = f"({lead('c', 6)} / nullif(c, 0) - 1) / 1000"


def _fit(s, d):
    """Bars with thresholds fitted on the first 60 % of each series."""
    b = apply(bars4h(s, d), {"i": rs.S.row() - 1})
    n = b.groupBy("sym").agg(F.count("*").alias("cnt"))
    b = b.join(n, "sym")
    fit = b.where(F.col("i") < F.floor(F.col("cnt") * 0.6)).groupBy("sym").agg(F.percentile("c", 0.1).alias("lo"), F.percentile("c", 0.9).alias("hi"), F.avg("c").alias("mu"), F.stddev_pop("c").alias("s0"), F.stddev_samp("c").alias("s1"))
    return b.join(fit, "sym")


_FIT = f"{BARS}, n as (select *, row_number() over ({P}) - 1 as i, count(*) over (partition by sym) as cnt, {_RET} as ret from bars), fit as (select sym, quantile_cont(c, 0.1) as lo, quantile_cont(c, 0.9) as hi, avg(c) as mu, stddev_pop(c) as s0, stddev_samp(c) as s1 from n where i < floor(cnt * 0.6) group by 1), b as (select * from n join fit using (sym))"
R.add("r01_fixed_thresholds", f"with {_FIT} select sym, t, case when c < lo then -1 when c > hi then 1 else 0 end as a, case when c < lo then 1 when c > hi then -1 else 0 end as b from b")(lambda s, d: _fit(s, d).select("sym", "t", rs.two_sided(F.col("c"), F.col("lo"), F.col("hi")).alias("a"), rs.two_sided(F.col("c"), F.col("lo"), F.col("hi"), -1).alias("b")))
R.add("r02_fixed_zscore", f"with {_FIT} select sym, t, case when (c - mu) / nullif(s0, 0) < -1 then -1 when (c - mu) / nullif(s0, 0) > 1 then 1 else 0 end as a from b")(lambda s, d: _fit(s, d).select("sym", "t", rs.zscore_signal(F.col("c"), F.col("mu"), F.col("s0"), -1.0, 1.0).alias("a")))
def _q(q: float, xs: str = "ys") -> str:
    """Linear quantile of a sorted list."""
    at = f"((len({xs}) - 1) * {q}::double)"
    return f"({xs}[floor({at})::int + 1] + ({xs}[ceil({at})::int + 1] - {xs}[floor({at})::int + 1]) * ({at} - floor({at})))"


def _recent(source: str, name: str, value: str, key: str) -> str:
    """CTE ``name``: rows of ``source`` with the sorted values (ys) of their look-back, where there are enough."""
    return f"""{name}1 as (select *, count(*) over (partition by {key}) as m, list({value}) over (partition by {key} order by t rows between 499 preceding and current row) as xs from {source}),
{name} as (select * from (select *, list_sort(xs[greatest(len(xs) - greatest(20, least(500, m // 3)) + 1, 1):]) as ys from {name}1) where len(ys) >= case when m < 20 then 10 else 20 end)"""


_MEAN, _STD = "list_avg(ys)", "(list_aggregate(ys, 'stddev_samp') + 1e-10)"
R.add("r03_rolling_signals", f"with {BARS}, {_recent('bars', 'k', 'c', 'sym')}, s as (select sym, t, case when c < {_q(0.1)} then -1 when c > {_q(0.9)} then 1 else 0 end as p, case when (c - {_MEAN}) / {_STD} < -1 then -1 when (c - {_MEAN}) / {_STD} > 1 then 1 else 0 end as z from k) select bars.sym, bars.t, coalesce(p, 0) as p, coalesce(z, 0) as z from bars left join s using (sym, t)")(
    lambda s, d: rs.recent(bars4h(s, d), "c", "xs").select("sym", "t", rs.rolling_percentile(F.col("c"), F.col("xs"), 0.1, 0.9).alias("p"), rs.rolling_z(F.col("c"), F.col("xs"), -1.0, 1.0).alias("z"))
)


def _signals3():
    return {"a": F.when(F.col("c") > 60, 1).when(F.col("c") < 30, -1).otherwise(0), "b": F.when(F.col("o") > 50, 1).when(F.col("o") < 25, -1).otherwise(0), "x": F.when(F.col("v") > 12, 1).when(F.col("v") < 9, -1).otherwise(0)}


_three = f"{BARS}, s as (select sym, t, case when c > 60 then 1 when c < 30 then -1 else 0 end as a, case when o > 50 then 1 when o < 25 then -1 else 0 end as b, case when v > 12 then 1 when v < 9 then -1 else 0 end as x from bars), u as (select *, (a > 0)::int + (b > 0)::int + (x > 0)::int as up, (a < 0)::int + (b < 0)::int + (x < 0)::int as dn from s)"
R.add("r04_combine", f"with {_three} select sym, t, case when a + b + x = 3 then 1 when a + b + x = -3 then -1 else 0 end as una, case when up >= 2 then 1 when dn >= 2 then -1 else 0 end as maj from u")(lambda s, d: apply(bars4h(s, d), _signals3()).select("sym", "t", rs.combine(["a", "b", "x"]).alias("una"), rs.combine(["a", "b", "x"], False).alias("maj")))
R.add("r05_symmetric", f"with {BARS}, s as (select sym, t, c - 50 as y from bars) select sym, t, case when y < -20 then -1 when y > 20 then 1 else 0 end as a, case when y < 10 then 0 when y > -10 then 1 else 0 end as b from s")(lambda s, d: bars4h(s, d).withColumn("y", F.col("c") - 50).select("sym", "t", rs.symmetric(F.col("y"), 20).alias("a"), rs.symmetric(F.col("y"), -10).alias("b")))
R.add("r06_fit_thresholds", f"with {_FIT} select sym, round(lo, 6) as lo, round(hi, 6) as hi, round(mu, 6) as mu, round(s0, 6) as s0, round(s1, 6) as s1 from fit")(lambda s, d: shown(_fit(s, d).dropDuplicates(["sym"]), "lo", "hi", "mu", "s0", "s1", key=("sym",)))
R.add("r07_votes", f"with {_three} select sym, t, case when up >= 2 and up > dn then 1 when dn >= 2 and dn > up then -1 else 0 end as vote from u")(lambda s, d: apply(bars4h(s, d), _signals3()).select("sym", "t", rs.votes(["a", "b", "x"]).alias("vote")))
R.add("r08_weighted_position", f"with {_three} select sym, t, round(case when abs((3 * a + 2 * b + x) / 6.0) >= 0.3 then (3 * a + 2 * b + x) / 6.0 else 0 end, 6) as position from s")(lambda s, d: shown(bt.ensemble(apply(bars4h(s, d), _signals3()), {"a": 3.0, "b": 2.0, "x": 1.0}), "position"))


def _with_ret(s, d):
    return apply(bars4h(s, d), {"ret": (F.try_divide(rs.S.lead("c", 6), F.col("c")) - 1) / 1000})


_PCTS = "[10, 20, 25, 30, 70, 75, 80, 90]"


def _fired(cols: str) -> str:
    return f"""n as (select *, {_RET} as ret, row_number() over ({P}) as i from bars),
lg as (unpivot (select sym, i, t, coalesce(ret, -999) as ret, {cols} from n) on {cols} into name indicator value value),
th as (select sym, indicator, unnest({_PCTS}) as pct, unnest(quantile_cont(value, [0.1, 0.2, 0.25, 0.3, 0.7, 0.75, 0.8, 0.9])) as threshold from lg group by 1, 2),
f as (select u.sym, u.i, u.t, u.ret, u.indicator, op, pct, threshold, case when op = '>' then value > threshold else value < threshold end as hit from lg u join th using (sym, indicator), (select unnest(['>', '<']) as op))"""


_GREEDY = """k as (select sym, indicator, op, pct, i, ret, threshold, hit as keep, case when hit then i + 6 else 0 end as free from f where i = 1
union all select f.sym, f.indicator, f.op, f.pct, f.i, f.ret, f.threshold, f.hit and f.i >= k.free, case when f.hit and f.i >= k.free then f.i + 6 else k.free end from f join k on f.sym = k.sym and f.indicator = k.indicator and f.op = k.op and f.pct = k.pct and f.i = k.i + 1)"""
R.add("r09_threshold_search", f"with recursive {BARS}, {_fired('c, v')}, {_GREEDY} select sym, indicator, op, pct, count(*) as support, round(avg((ret > 0)::int), 6) as win, round(threshold, 6) as threshold from k where keep group by sym, indicator, op, pct, threshold having count(*) >= 5")(
    lambda s, d: rs.mine(_with_ret(s, d), ["c", "v"], min_trades=5, min_win=0.5).select("sym", "indicator", "op", "pct", "support", F.round("win", 6).alias("win"), F.round("threshold", 6).alias("threshold"))
)
_C2 = "c2 as (select a.sym, a.i, a.t, a.ret, a.indicator || a.op || a.pct as a, b.indicator || b.op || b.pct as b, row_number() over (partition by a.sym, a.indicator, a.op, a.pct, b.indicator, b.op, b.pct order by a.i) as j from f a join f b on a.sym = b.sym and a.i = b.i and a.hit and b.hit and a.indicator < b.indicator)"
R.add("r10_all_pairs", f"with recursive {BARS}, {_fired('c, v')}, {_C2}, k as (select sym, a, b, j, i, ret, true as keep, i + 6 as free from c2 where j = 1 union all select c2.sym, c2.a, c2.b, c2.j, c2.i, c2.ret, c2.i >= k.free, case when c2.i >= k.free then c2.i + 6 else k.free end from c2 join k on c2.sym = k.sym and c2.a = k.a and c2.b = k.b and c2.j = k.j + 1) select sym, a, b, count(*) as support, round(avg((ret > 0)::int), 6) as win from k where keep group by 1, 2, 3 having count(*) >= 3")(
    lambda s, d: rs.pairs(_with_ret(s, d), ["c", "v"], min_trades=3).select("sym", "a", "b", "support", F.round("win", 6).alias("win"))
)
_BEST = f"""{_GREEDY}, m as (select sym, indicator, op, pct, count(*) as support, avg((ret > 0)::int) as win from k where keep group by 1, 2, 3, 4 having count(*) >= 5),
bs as (select sym, indicator, op, pct, row_number() over (partition by sym order by greatest(win, 1 - win) desc, support desc, indicator, op, pct) as rk from m where win >= 0.5 or win <= 0.5),
fb as (select f.* from f join bs using (sym, indicator, op, pct) where rk <= 20 and f.hit),
c2 as (select a.sym, a.i, a.ret, a.indicator || a.op || a.pct as a, b.indicator || b.op || b.pct as b, row_number() over (partition by a.sym, a.indicator, a.op, a.pct, b.indicator, b.op, b.pct order by a.i) as j from fb a join fb b on a.sym = b.sym and a.i = b.i and a.indicator < b.indicator),
k2 as (select sym, a, b, j, i, ret, true as keep, i + 6 as free from c2 where j = 1 union all select c2.sym, c2.a, c2.b, c2.j, c2.i, c2.ret, c2.i >= k2.free, case when c2.i >= k2.free then c2.i + 6 else k2.free end from c2 join k2 on c2.sym = k2.sym and c2.a = k2.a and c2.b = k2.b and c2.j = k2.j + 1),
g2 as (select sym, a, b, count(*) as support, avg((ret > 0)::int) as win from k2 where keep group by 1, 2, 3 having count(*) >= 3)"""
R.add("r10_pair_search", f"with recursive {BARS}, {_fired('c, v, o')}, {_BEST} select sym, a, b, support, round(win, 6) as win, case when win >= 0.5 then 1 else -1 end as direction, round(case when win >= 0.5 then win else 1 - win end, 6) as confidence from g2 where win >= 0.6 or win <= 0.4")(
    lambda s, d: rs.pair_rules(_with_ret(s, d), ["c", "v", "o"], min_trades=3, min_win=0.6, base_trades=5, base_win=0.5).select("sym", "a", "b", "support", F.round("win", 6).alias("win"), "direction", F.round("confidence", 6).alias("confidence"))
)
R.add("r15_top_rules", f"with recursive {BARS}, {_fired('o, h, l, c, v')}, {_GREEDY}, g as (select sym, indicator, op, pct, count(*) as support, avg((ret > 0)::int) as win from k where keep group by 1, 2, 3, 4 having count(*) >= 10) select sym, indicator, op, pct, support, round(win, 6) as win, case when win >= 0.5 then 1 else -1 end as direction, round(case when win >= 0.5 then win else 1 - win end, 6) as confidence from g order by case when win >= 0.5 then win else 1 - win end desc, support desc, sym, indicator, op, pct limit 10")(
    lambda s, d: rs.ranked(rs.mine(_with_ret(s, d), ["o", "h", "l", "c", "v"], min_trades=10, min_win=0.5), 10).select("sym", "indicator", "op", "pct", "support", F.round("win", 6).alias("win"), "direction", F.round("confidence", 6).alias("confidence"))
)
R.add("r13_rule_stats", f"with {BARS}, n as (select *, {_RET} as ret from bars) select sym, count(ret) as n, round(avg(ret), 9) as mean, round(avg((ret > 0)::int), 6) as win from n where (c > 60 or (c < 20 and v > 9)) and ret is not null group by 1")(
    lambda s, d: (b := _with_ret(s, d)).where(Rule("x", (Condition("c", ">", 60.0),)).column(b.columns) | Rule("y", (Condition("c", "<", 20.0), Condition("v", ">", 9.0))).column(b.columns)).where("ret is not null").groupBy("sym").agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 9).alias("mean"), F.round(F.avg(flag(F.col("ret") > 0)), 6).alias("win"))
)


_TH = [0.5, 0.52, 0.55, 0.6, 0.7, 0.75, 0.8, 0.9]


@R.add("r14_similar_rules", f"with recursive {BARS}, q as (select unnest(range(1, 9)) as i, unnest(quantile_cont(c, {_TH})) as th from bars), k as (select i, th, true as keep, [th] as kept from q where i = 1 union all select i, th, ok, case when ok then list_append(kept, th) else kept end from (select q.i, q.th, k.kept, len(list_filter(k.kept, lambda x: abs(q.th - x) / (abs(x) + 1e-8) <= 0.1)) = 0 as ok from k join q on q.i = k.i + 1)) select 'over_' || i as rule, round(th, 6) as threshold from k where keep")
def _(s, d):
    th = bars4h(s, d).agg(F.percentile("c", _TH).alias("th")).first().th
    kept = rs.similar([Rule(f"over_{i + 1}", (Condition("c", ">", x),)) for i, x in enumerate(th)])
    return s.createDataFrame([(r.name, round(r.conditions[0].threshold, 6)) for r in kept], "rule string, threshold double")


R.add("r16_time_exit", staged({"exit_return": f"{div(lead('c', 6), 'c')} - 1"}))(lambda s, d: shown(rs.time_exit(bars4h(s, d)), "exit_return"))
def _binomial(k: str, n: str) -> str:
    """P(X >= k) of a fair coin."""
    return f"least(1, list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)))))"


_PAT_COLS = ["atr", "trend", "rsi"]


def _pattern_frame(s, d):
    return apply(_with_ret(s, d), {"atr": F.col("h") - F.col("l"), "trend": F.col("c") - rs.S.lag("c", 6), "rsi": F.col("c")})


def _patterns_sql() -> str:
    tried = rs.candidate_patterns(_PAT_COLS)
    pcts = sorted({p for _, _, p in tried})
    q = ", ".join(f"quantile_cont({c}, {p / 100}) as {c}_{p}" for c in _PAT_COLS for p in pcts)
    rows = [f"select sym, '{c}{o}{p}' as pattern, ret from n join q using (sym) where {c} {o} {c}_{p}" for c, o, p in tried]
    rows += ["select sym, 'hour==' || ((t % 86400) // 3600), ret from n", "select sym, 'dow==' || ((t // 86400 + 3) % 7), ret from n", "select sym, 'rsi=40..60', ret from n where rsi > 40 and rsi < 60"]
    return f"""with {BARS}, n0 as (select *, {_RET} as ret, h - l as atr, c - {lag('c', 6)} as trend, c as rsi from bars), n as (select * from n0 where ret is not null),
q as (select sym, {q} from n group by 1), x as ({' union all '.join(rows)}), z as (select sym, count(*) as bars from n group by 1),
g as (select sym, pattern, count(*) as n, sum((ret < 0)::int)::bigint as losses, avg(ret) filter (where ret < 0) as mean_loss from x group by 1, 2),
r as (select g.*, losses / n as loss_rate, n / bars as frequency, 1 - {_binomial('losses', 'n')} as confidence from g join z using (sym))
select sym, pattern, n, losses, round(loss_rate, 6) as loss_rate, round(mean_loss, 9) as mean_loss, round(frequency, 6) as frequency, round(confidence, 6) as confidence from r
where n >= 10 and loss_rate >= case when pattern like 'hour==%' or pattern like 'dow==%' then 0.5 + 0.05 else 0.5 end and confidence > 0.5"""


R.add("r19_loss_patterns", _patterns_sql())(
    lambda s, d: rs.loss_patterns(_pattern_frame(s, d), _PAT_COLS, min_n=10, loss_rate=0.5, confidence=0.5).select("sym", "pattern", "n", "losses", F.round("loss_rate", 6).alias("loss_rate"), F.round("mean_loss", 9).alias("mean_loss"), F.round("frequency", 6).alias("frequency"), F.round("confidence", 6).alias("confidence"))
)


@R.add("r20_binomial", f"with {BARS}, n as (select *, {_RET} as ret from bars), g as (select sym, count(ret) as n, sum((ret < 0)::int)::bigint as k from n group by 1) select sym, n, k, round({_binomial('k', 'n')}, 6) as p from g")
def _(s, d):
    x = _with_ret(s, d).groupBy("sym").agg(F.count("ret").alias("n"), F.count_if(F.col("ret") < 0).alias("k"))
    return x.select("sym", "n", "k", F.round(stats.binomial_pvalue(F.col("k"), F.col("n")), 6).alias("p"))


R.add("r21_market_regimes", f"with {BARS}, n0 as (select *, h - l as rg, {_RET} as ret from bars), q as (select sym, quantile_cont(rg, 0.25) as v25, quantile_cont(rg, 0.75) as v75, quantile_cont(c, 0.5) as tm, quantile_cont(v, 0.25) as l25 from n0 group by 1), x as (select sym, ret, [case when rg <= v25 then 'low_vol' when rg <= v75 then 'normal_vol' else 'high_vol' end, case when c <= tm then 'weak_trend' else 'strong_trend' end, case when v <= l25 then 'low_liquidity' else 'normal_liquidity' end] as rs, count(*) over (partition by sym) as bars from n0 join q using (sym) where ret is not null), g as (select sym, regime, count(*) as n, avg((ret > 0)::int) as win, avg(ret) as mean, count(*) / max(bars) as frequency from (select sym, ret, bars, unnest(rs) as regime from x) group by 1, 2) select sym, regime, n, round(win, 6) as win, round(mean, 9) as mean, round(frequency, 6) as frequency, case when win < 0.45 then 'avoid' when win < 0.5 then 'reduce_size' else 'trade' end as recommendation from g where n >= 30")(
    lambda s, d: rs.market_regimes(apply(_with_ret(s, d), {"rg": F.col("h") - F.col("l")}), "rg", "c", "v", least=30).select("sym", "regime", "n", F.round("win", 6).alias("win"), F.round("mean", 9).alias("mean"), F.round("frequency", 6).alias("frequency"), "recommendation")
)


def _sharpe(r: str = "r") -> str:
    """Daily geometric return over daily spread, annualised."""
    spread = f"(stddev_pop({r}) * sqrt(count({r}) / any_value(days)))"
    total = f"(product(1 + {r}) - 1)"
    return f"case when count({r}) >= 2 and {spread} >= 1e-10 then (case when {total} > -1 then power(1 + {total}, 1 / any_value(days)) - 1 else -1 end) / {spread} * sqrt(365) else 0 end"


def _verdict_sql(key: str, too_good: bool, min_trades: int) -> str:
    """From trades tr (key, oos, r, days): figures of both parts and the verdict."""
    cols = [c.strip() for c in key.split(",")]
    on = " and ".join(f"a.{c} = b.{c}" for c in cols)
    better = "when keep > 1 then 'SUSPICIOUS_OOS_BETTER' " if too_good else ""
    return f"""g as (select {key}, oos, count(r) as n, {_sharpe()} as sharpe, avg((r > 0)::int) as win, stddev_samp(r) as sd from tr group by {key}, oos),
j as (select a.*, coalesce(b.n, 0) as oos_n, coalesce(b.sharpe, 0) as oos_sharpe, b.win as oos_win, b.sd as oos_sd from (select * from g where not oos) a left join (select * from g where oos) b on {on}),
w as (select *, coalesce(oos_n >= 25 and oos_sd >= 1e-10, false) as enough, case when coalesce(oos_n >= 25 and oos_sd >= 1e-10, false) then oos_sharpe / (sharpe + 1e-10) else 0 end as keep from j where n >= {min_trades} and sd >= 1e-10)
select {key}, n as is_n, round(win, 6) as is_win, round(sharpe, 4) as is_sharpe, oos_n, round(oos_win, 6) as oos_win, round(oos_sharpe, 4) as oos_sharpe, round(keep, 4) as retention,
  case when not enough then 'INSUFFICIENT_DATA' {better}when oos_sharpe >= 1.0 and keep >= 0.4 and oos_win >= 0.52 then 'CREDIBLE' else 'OOS_FAILED' end as verdict from w"""


def _shown_verdicts(df, *key):
    return df.select(*key, "is_n", F.round("is_win", 6).alias("is_win"), F.round("is_sharpe", 4).alias("is_sharpe"), "oos_n", F.round("oos_win", 6).alias("oos_win"), F.round("oos_sharpe", 4).alias("oos_sharpe"), F.round("retention", 4).alias("retention"), "verdict")


def _split_sql(cols: str) -> str:
    return f"""n as (select *, {_RET} * 20 as ret from bars), w0 as (select *, row_number() over ({P}) - 1 as i, count(*) over (partition by sym) as cnt from n where ret is not null),
dy as (select sym, i >= floor(cnt * 0.6) as oos, greatest(1.0, count(*) / 6.0) as days from w0 group by 1, 2),
lg as (select * exclude (i, cnt), i >= floor(cnt * 0.6) as oos from (unpivot (select sym, t, ret, i, cnt, {cols} from w0) on {cols} into name indicator value value))"""


_OWN = " union all ".join([f"select sym, t, ret, oos, indicator, value, 'pct_{b}' as config, {_q(a / 100)} as lo, {_q(b / 100)} as hi from k" for a, b in rs.PAIRS] + [f"select sym, t, ret, oos, indicator, value, 'z_{b:g}', {_MEAN} - {b} * {_STD}, {_MEAN} + {b} * {_STD} from k" for _, b in rs.Z_PAIRS])
_FITTED = " union all ".join([f"select sym, indicator, 'pct_{b}' as config, p{a} as lo, p{b} as hi from ft" for a, b in rs.PAIRS] + [f"select sym, indicator, 'z_{b:g}', mu - {b} * (sd + 1e-10), mu + {b} * (sd + 1e-10) from ft" for _, b in rs.Z_PAIRS])
_TS = f"""with {BARS}, {_split_sql('c, v')}, {_recent('(select * from lg where not oos)', 'k', 'value', 'sym, indicator')},
ft as (select sym, indicator, {', '.join(f'quantile_cont(value, {p / 100}) as p{p}' for p in (10, 20, 30, 70, 80, 90))}, avg(value) as mu, stddev_samp(value) as sd from lg where not oos group by 1, 2 having count(value) >= 30),
al as ({_OWN} union all select lg.sym, t, ret, oos, lg.indicator, value, config, lo, hi from lg join ({_FITTED}) cf on lg.sym = cf.sym and lg.indicator = cf.indicator where oos),
tr as (select al.sym, al.indicator, config, dir as direction, al.oos, days, (case when value < lo then -dir else dir end) * ret - 0.0012 as r from al join dy on al.sym = dy.sym and al.oos = dy.oos, (select unnest([1, -1]) as dir) where value < lo or value > hi),
{_verdict_sql('sym, indicator, config, direction', True, 5)}"""


def _tested(s, d):
    return apply(bars4h(s, d), {"ret": (F.try_divide(rs.S.lead("c", 6), F.col("c")) - 1) / 1000 * 20})


R.add("r22_is_oos_figures", _TS)(lambda s, d: _shown_verdicts(rs.tester(_tested(s, d), ["c", "v"], min_trades=5), "sym", "indicator", "config", "direction"))
_SIDES = " union all ".join(f"select sym, t, oos, ret, indicator, 'pct_{b}' as config, case when value < {_q(a / 100)} then -1 when value > {_q(b / 100)} then 1 else 0 end as side from k" for a, b in rs.PAIRS)


def _sets_sql(size: int) -> str:
    names = [f"x{i}" for i in range(size)]
    joins = "".join(f" join sd {x} on {x}.sym = x0.sym and {x}.t = x0.t and {x}.config = x0.config and {x}.side = x0.side and {x}.indicator > {names[i]}.indicator" for i, x in enumerate(names[1:]))
    key = " || '+' || ".join(f"{x}.indicator" for x in names)
    return f"""with {BARS}, {_split_sql('o, h, c, v')}, {_recent('lg', 'k', 'value', 'sym, oos, indicator')}, sd as (select * from ({_SIDES}) where side <> 0),
tr as (select x0.sym, {key} as indicators, x0.config, dir as direction, x0.oos, days, x0.side * dir * x0.ret - 0.0012 as r from sd x0{joins} join dy on x0.sym = dy.sym and x0.oos = dy.oos, (select unnest([1, -1]) as dir)),
{_verdict_sql('sym, indicators, config, direction', False, 5)}"""


for _size, _name in ((2, "r23_pairs"), (3, "r23_triples")):
    R.add(_name, _sets_sql(_size))(lambda s, d, size=_size: _shown_verdicts(rs.combinations(_tested(s, d), ["o", "h", "c", "v"], size, min_trades=5), "sym", "indicators", "config", "direction"))


@R.add("r24_search_summary", None)
def _(s, d):
    return rs.search(_tested(s, d), ["o", "h", "l", "c", "v", "n"], min_is_sharpe=0.5, min_trades=5, min_oos=5)["summary"]


_sg = "s as (select sym, case when c > 60 then 1 when c < 30 then -1 else 0 end as a, case when c > 58 then 1 when c < 30 then -1 else 0 end as a2, case when o > 50 then 1 when o < 25 then -1 else 0 end as b, case when v > 12 then 1 when v < 9 then -1 else 0 end as x from bars)"
_ok = lambda p, q: f"coalesce(nullif(abs(corr({p}, {q})), 'NaN'::double), 0) <= 0.8"


@R.add("r25_correlated_rules", f"with {BARS}, {_sg}, k as (select {_ok('a', 'a2')} as a2, {_ok('a', 'b')} as b1, {_ok('a2', 'b')} as b2, {_ok('a', 'x')} as x1, {_ok('a2', 'x')} as x2, {_ok('b', 'x')} as x3 from s), g as (select a2, b1 and (b2 or not a2) as b, x1, x2, x3 from k) select 'a' as signal union all select 'a2' from g where a2 union all select 'b' from g where b union all select 'x' from g where x1 and (x2 or not a2) and (x3 or not b)")
def _(s, d):
    b = apply(bars4h(s, d), _signals3() | {"a2": F.when(F.col("c") > 58, 1).when(F.col("c") < 30, -1).otherwise(0)})
    return s.createDataFrame([(x,) for x in rs.correlated(b, ["a", "a2", "b", "x"], ["a", "a2", "b", "x"])], "signal string")


_CRITIC = [Rule("high", (Condition("c", ">", 60.0),), direction="SHORT"), Rule("low", (Condition("c", "<", 25.0),)), Rule("leak", (Condition("return_next", ">", 0.0),)), Rule("raw", (Condition("close", ">", 60.0),)), Rule("busy", (Condition("volume", ">", 11.0), Condition("c", "<", 50.0)))]
R.add("r27_critic", None)(lambda s, d: rs.critique(apply(_with_ret(s, d), {"reg": F.when(F.col("v") > 11, "busy").otherwise("calm"), "close": F.col("c"), "volume": F.col("v")}), _CRITIC, regime="reg", min_trades=15))
R.add("r28_quantile_backtest", f"with {_FIT}, k as (select sym, quantile_cont(c, 0.33) as a, quantile_cont(c, 0.67) as z from n where i < floor(cnt * 0.67) group by 1) select sym, i >= floor(cnt * 0.67) as oos, count(*) as n, round(avg((case when c < a then 1 else -1 end) * ret), 9) as mean from n join k using (sym) where (c < a or c > z) and ret is not null group by 1, 2")(lambda s, d: _thirds(s, d))


def _thirds(s, d):
    b = apply(_with_ret(s, d), {"i": rs.S.row() - 1})
    b = b.join(b.groupBy("sym").agg(F.count("*").alias("cnt")), "sym")
    inside = F.col("i") < F.floor(F.col("cnt") * 0.67)
    k = b.where(inside).groupBy("sym").agg(F.percentile("c", 0.33).alias("a"), F.percentile("c", 0.67).alias("z"))
    b = b.join(k, "sym").where("(c < a or c > z) and ret is not null")
    return b.groupBy("sym", (~inside).alias("oos")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("c") < F.col("a"), 1).otherwise(-1) * F.col("ret")), 9).alias("mean"))


R.add("r29_integer_grid", f"with {BARS}, n as (select *, {_RET} as ret from bars), g as (select unnest(range(20, 90, 10)) as th) select sym, th::int as th, count(ret) as n, round(avg(ret), 9) as mean from n, g where c > th and ret is not null group by 1, 2")(
    lambda s, d: _with_ret(s, d).withColumn("th", F.explode(F.sequence(F.lit(20), F.lit(80), F.lit(10)))).where("c > th and ret is not null").groupBy("sym", "th").agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 9).alias("mean"))
)
R.add("m12_statistics", f"with {BARS}, n as (select *, {div('c', lag('c'))} - 1 as r from bars), a as (select sym, avg(r) as mu, stddev_pop(r) as sd from n group by 1) select sym, count(r) as n, round(avg(r), 6) as mean, round(avg(r) / (stddev_samp(r) / sqrt(count(r))), 6) as t, round(avg(power((r - mu) / sd, 3)), 5) as skew from n join a using (sym) where r is not null group by 1")(
    lambda s, d: rs.statistics(apply(bars4h(s, d), {"r": rs.S.pct_change("c")})).select("sym", "n", F.round("mean", 6).alias("mean"), F.round("t", 6).alias("t"), F.round("skew", 5).alias("skew"))
)
_F = f"n as (select *, row_number() over ({P}) - 1 as i, count(*) over (partition by sym) as cnt, {roll('avg', 'c', 20)} as m20, {roll('stddev_samp', 'c', 20)} as s20, ({lead('c', 6)} / nullif(c, 0) - 1) / 1000 as ret from bars)"


def flagship_sql() -> str:
    """CTEs of the flagship query; the last one, ``final``, holds its rows."""
    return f"""with {BARS}, {_F}, z as (select *, (c - m20) / nullif(s20, 0) as z from n), k as (select sym, quantile_cont(z, 0.1) as lo, quantile_cont(z, 0.9) as hi from z where i < floor(cnt * 0.6) group by 1), x as (select z.*, case when z < lo then 1 when z > hi then -1 else 0 end as sig from z join k using (sym)), final as (select sym, i >= floor(cnt * 0.6) as oos, count(*) as n_trades, round(avg(sig * ret), 9) as mean_return, round(avg((sig * ret > 0)::int), 6) as win_rate from x where sig <> 0 and ret is not null group by 1, 2)"""


R.add("flagship_signal_backtest", f"{flagship_sql()} select * from final")(lambda s, d: flagship(s, d))


def flagship(s, d):
    """Bars, a 20-bar z-score, its outer deciles on the first 60 % as a signal, figures of six-bar trades in and out of sample."""
    b = apply(_with_ret(s, d), {"z": rs.S.zscore("c", 20), "i": rs.S.row() - 1})
    n = b.groupBy("sym").agg(F.count("*").alias("cnt"))
    b = b.join(n, "sym")  # one row for each series
    oos = F.col("i") >= F.floor(F.col("cnt") * 0.6)
    k = b.where(~oos).groupBy("sym").agg(F.percentile("z", 0.1).alias("lo"), F.percentile("z", 0.9).alias("hi"))
    b = b.join(k, "sym").withColumn("sig", F.when(F.col("z") < F.col("lo"), 1).when(F.col("z") > F.col("hi"), -1).otherwise(0)).where("sig <> 0 and ret is not null")
    r = F.col("sig") * F.col("ret")
    return b.groupBy("sym", oos.alias("oos")).agg(F.count("*").alias("n_trades"), F.round(F.avg(r), 9).alias("mean_return"), F.round(F.avg(flag(r > 0)), 6).alias("win_rate"))
