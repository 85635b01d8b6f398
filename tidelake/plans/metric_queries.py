"""Metrics and backtests as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions.sqlkit import BARS, P, lag, lead
from tidelake.operators import backtest as bt
from tidelake.operators import metrics as m
from tidelake.operators.features import apply

from .base import Registry, bars4h, shown

R = Registry()
SIG = "case when c > 60 then -1 when c < 25 then 1 else 0 end"
_T = f"{BARS}, s as (select *, {SIG} as sig, ({lead('c', 6)} / nullif(c, 0) - 1) / 1000 as ret from bars), tr as (select sym, t, sig * ret as r from s where sig <> 0 and ret is not null), d as (select sym, count(*) as bars, count(*) / 6.0 as days from bars group by 1), j as (select * from tr join d using (sym))"
_ALL = "(bars)"


def signals(s, d) -> DataFrame:
    """Bars with a signal and the (scaled) return over six bars."""
    sig = F.when(F.col("c") > 60, -1).when(F.col("c") < 25, 1).otherwise(0)
    return apply(bars4h(s, d), {"sig": sig, "ret": (F.try_divide(F.lead("c", 6).over(bt.S.o), F.col("c")) - 1) / 1000})


def trades(s, d) -> DataFrame:
    """Returns of trades with days and bars of their series."""
    b = signals(s, d)
    size = b.groupBy("sym").agg(F.count("*").alias("bars"), (F.count("*") / 6).alias("days"))
    return b.where("sig <> 0 and ret is not null").select("sym", "t", (F.col("sig") * F.col("ret")).alias("r")).join(size, "sym")


def _sharpe_sql(k: m.Sharpe) -> str:
    std = "stddev_samp(r)" if k.ddof else "stddev_pop(r)"
    if k.by == "daily":
        spread = f"({std} * sqrt(count(r) / any_value(days)))"
        e = f"case when count(r) >= {k.at_least} and {spread} >= {k.zero} then (power(product(1 + r), 1 / any_value(days)) - 1) / {spread} * sqrt(365) end"
    else:
        year = {"bars": "2190", "trades": "(count(r) / any_value(days) * 365)", "days90": "(count(r) / 90.0 * 365)", "capped": "least(count(r), 2190)", "share": "(2190.0 * count(r) / any_value(bars))"}[k.by]
        e = f"case when count(r) >= {k.at_least} and {std} > {k.zero} then avg(r) / ({std} + {k.eps}) * sqrt({year}) end"
    e = f"coalesce({e}, 0)"
    if k.limit:
        e = f"least(greatest({e}, -{k.limit}), {k.limit})"
    return f"round({e}, {k.digits or 6})"


for _name, _k in m.SHARPE.items():
    if _name == "h03_equity_curve":
        continue

    def _query(s, d, name=_name):
        return trades(s, d).groupBy("sym").agg(F.round(m.sharpe(name, F.col("r"), F.first("days"), F.first("bars")), 6).alias("sharpe"))

    R.add(f"{_name}_sharpe", f"with {_T} select sym, {_sharpe_sql(_k)} as sharpe from j group by 1")(_query)

_EQ = f"e as (select sym, t, days, bars, product(1 + r) over ({P} rows unbounded preceding) as equity from j)"
R.add("h03_equity_curve_sharpe", f"with {_T}, {_EQ}, q as (select sym, days, bars, equity / ({lag('equity')} + 1e-10) - 1 as r from e) select sym, round(avg(r) / stddev_samp(r) * sqrt(count(r) / any_value(days) * 365), 4) as sharpe from q group by 1")(
    lambda s, d: apply(m.equity(trades(s, d)), {"er": F.col("equity") / (bt.S.lag("equity") + 1e-10) - 1}).groupBy("sym").agg(m.sharpe("h03_equity_curve", F.col("er"), F.first("days")).alias("sharpe"))
)
R.add("h04_sortino", f"with {_T} select sym, round(avg(r) / stddev_samp(r) filter (where r < 0) * sqrt(count(r) / any_value(days) * 365), 6) as sortino from j group by 1")(lambda s, d: trades(s, d).groupBy("sym").agg(F.round(m.sortino(F.col("r"), F.first("days")), 6).alias("sortino")))
R.add("h16_objective_score", f"with {_T} select sym, round(0.5 * least(greatest({_sharpe_sql(m.SHARPE['h16_objective'])} / 3, -1), 1) + 0.3 * (avg((r > 0)::int) - 0.5) * 2, 5) as score from j group by 1")(lambda s, d: trades(s, d).groupBy("sym").agg(F.round(m.objective(F.col("r"), F.lit(None).cast("double"), F.first("days")), 5).alias("score")))
R.add("m01_shifted_returns", f"with {_T} select sym, t, round(coalesce({lag('sig')}, 0) * ret, 9) + 0.0 as r from s")(lambda s, d: shown(bt.strategy_returns(signals(s, d)), "r", digits=9))
_DD = f"with {_T}, {_EQ}, g as (select sym, t, equity, equity / greatest(max(equity) over ({P} rows unbounded preceding), 1.0) - 1 as drawdown from e)"
R.add("m02_equity_drawdown", f"{_DD} select sym, t, round(equity, 6) as equity, round(drawdown, 6) as drawdown from g")(lambda s, d: shown(m.equity(trades(s, d)), "equity", "drawdown"))
R.add("m02_max_drawdown", f"{_DD} select sym, round(min(drawdown), 6) as max_drawdown from g group by 1")(lambda s, d: m.equity(trades(s, d)).groupBy("sym").agg(F.round(F.min("drawdown"), 6).alias("max_drawdown")))
R.add("m03_cost_on_change", f"with {_T}, p as (select sym, t, ret, coalesce({lag('sig')}, 0) as pos from s) select sym, t, round(pos * ret, 9) + 0.0 as gross, round(pos * ret - 0.0006 * abs(pos - coalesce({lag('pos')}, 0)), 9) + 0.0 as r from p")(lambda s, d: shown(bt.costed(signals(s, d)), "gross", "r", digits=9))
R.add("m04_trade_log", f"with {_T}, x as (select sym, t, sig as side, c as entry, {lead('c', 6)} as exit from s) select sym, t, side, entry, exit, round(side * (exit / nullif(entry, 0) - 1), 6) as gross, round(side * (exit / nullif(entry, 0) - 1) - 0.001275, 6) as net from x where side <> 0 and exit is not null")(
    lambda s, d: bt.trade_log(signals(s, d), cost=bt.round_trip()).select("sym", "t", "side", "entry", "exit", F.round("gross", 6).alias("gross"), F.round("net", 6).alias("net"))
)
_tb = lambda r: f"case when count({r}) >= 5 and stddev_pop({r}) * sqrt(count({r}) / any_value(days)) >= 1e-10 then (power(product(1 + {r}), 1 / any_value(days)) - 1) / (stddev_pop({r}) * sqrt(count({r}) / any_value(days))) * sqrt(365) else 0 end"
R.add("m05_cost_scenarios", f"with {_T}, k as (select * from (values ('optimistic', 0.0006375::double), ('base', 0.001275), ('pessimistic', 0.0019125), ('high_volume', 0.001275)) v(scenario, cost)), g as (select sym, scenario, cost, {_tb('r')} as gs, {_tb('(r - cost)')} as ns, product(1 + r - cost) - 1 as nr, avg((r > cost)::int) as w from j, k group by 1, 2, 3) select sym, scenario, round(cost, 7) as cost, round(gs, 5) as gross_sharpe, round(ns, 5) as net_sharpe, round(nr, 6) as net_return, round(w, 6) as net_win, round(case when gs > 0 then (gs - ns) / gs * 100 else 0 end, 3) as sharpe_decay from g")(
    lambda s, d: bt.scenarios(trades(s, d)).select("sym", "scenario", F.round("cost", 7).alias("cost"), F.round("gross_sharpe", 5).alias("gross_sharpe"), F.round("net_sharpe", 5).alias("net_sharpe"), F.round("net_return", 6).alias("net_return"), F.round("net_win", 6).alias("net_win"), F.round("sharpe_decay", 3).alias("sharpe_decay"))
)
R.add("m06_ensemble_position", f"with {BARS} select sym, t, case when abs(p) >= 0.3 then round(p, 6) else 0 end as position from (select sym, t, (2.0 * (case when c > 60 then -1 when c < 25 then 1 else 0 end) + 1.0 * (case when v > 14 then 1 else 0 end)) / 3 as p from bars)")(
    lambda s, d: shown(bt.ensemble(apply(signals(s, d), {"s2": F.when(F.col("v") > 14, 1).otherwise(0)}), {"sig": 2.0, "s2": 1.0}), "position")
)
_N = f"n as (select *, row_number() over ({P}) - 1 as i, count(*) over (partition by sym) as cnt from s)"
R.add("m06_is_oos", f"with {_T}, {_N} select sym, i >= floor(cnt * 0.6) as oos, count(*) as n, round(avg(sig * ret), 9) as mean from n where sig <> 0 and ret is not null group by 1, 2")(
    lambda s, d: bt.split(signals(s, d), purge=0).where("sig <> 0 and ret is not null").groupBy("sym", (F.col("split") != "train").alias("oos")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("sig") * F.col("ret")), 9).alias("mean"))
)
R.add("m07_fixed_payoff", f"with {_T}, x as (select sym, t, case when r > 0 then 0.008 else -0.008 end as p from j) select sym, t, round(1 + sum(p) over ({P} rows unbounded preceding), 6) as equity from x")(lambda s, d: shown(m.equity(apply(trades(s, d), {"p": F.when(F.col("r") > 0, 0.008).otherwise(-0.008)}), "p", additive=True), "equity"))
R.add("m08_walk_forward", f"with {_T}, {_N}, q as (select *, floor(cnt / 3.0)::bigint as size, least(i // (cnt // 3), 2) as period from n) select sym, period::int as period, (i - period * size >= floor(size * 0.7)) as oos, count(*) as n, round(avg(sig * ret), 9) as mean from q where sig <> 0 and ret is not null group by 1, 2, 3")(
    lambda s, d: bt.periods(signals(s, d)).where("sig <> 0 and ret is not null").groupBy("sym", "period", "oos").agg(F.count("*").alias("n"), F.round(F.avg(F.col("sig") * F.col("ret")), 9).alias("mean"))
)
R.add("m09_summary", f"with {_T}, a as (select sym, avg(r) as mu, stddev_pop(r) as sd from j group by 1) select sym, count(r) as n_trades, round(product(1 + r) - 1, 6) as total_return, round(avg(r), 9) as mean_return, round(stddev_samp(r), 9) as std_return, round(avg((r > 0)::int), 6) as win_rate, round(sum(r) filter (where r > 0) / abs(sum(r) filter (where r < 0)), 6) as profit_factor, round(avg(r) filter (where r > 0), 9) as avg_win, round(avg(r) filter (where r < 0), 9) as avg_loss, round(max(r), 9) as best, round(min(r), 9) as worst, round(quantile_cont(r, 0.05), 9) as var95, round(avg(power((r - mu) / sd, 3)), 5) as skew from j join a using (sym) group by 1")(
    lambda s, d: (g := trades(s, d).groupBy("sym").agg(*m.summary(F.col("r"), F.first("days")))).select("sym", "n_trades", F.round("total_return", 6).alias("total_return"), *[F.round(x, 9).alias(x) for x in ("mean_return", "std_return", "avg_win", "avg_loss", "best", "worst", "var95")], F.round("win_rate", 6).alias("win_rate"), F.round("profit_factor", 6).alias("profit_factor"), F.round("skew", 5).alias("skew"))
)
R.add("m09_sanity", f"with {_T}, g as (select sym, count(r) as n_trades, avg((r > 0)::int) as w from j group by 1) select sym, n_trades < 10 as few, w > 0.9 as lucky from g")(
    lambda s, d: m.insane(trades(s, d).groupBy("sym").agg(*m.summary(F.col("r"), F.first("days")))).select("sym", F.array_contains("problems", "n_trades").alias("few"), F.array_contains("problems", "win_rate").alias("lucky"))
)
R.add("m10_weighted_combine", f"with {_T}, g as (select sym, count(r) as n, avg(r) as mu from j group by 1) select round(sum(n * mu) / sum(n), 9) as mean, sum(n)::bigint as n from g")(lambda s, d: trades(s, d).groupBy("sym").agg(F.count("r").alias("n"), F.avg("r").alias("mu")).agg(F.round(F.sum(F.col("n") * F.col("mu")) / F.sum("n"), 9).alias("mean"), F.sum("n").alias("n")))
R.add("m11_regimes", f"with {_T}, q as (select sym, median(v) as med from s group by 1) select sym, case when v > med then 'high' else 'low' end as regime, count(*) as n, round(avg(sig * ret), 9) as mean from s join q using (sym) where sig <> 0 and ret is not null group by 1, 2")(
    lambda s, d: bt.regimes(signals(s, d), "v").where("sig <> 0 and ret is not null").groupBy("sym", "regime").agg(F.count("*").alias("n"), F.round(F.avg(F.col("sig") * F.col("ret")), 9).alias("mean"))
)
R.add("m13_delays", f"with {_T} " + " union all ".join(f"select sym, {k} as delay, round(avg(coalesce(x, 0) * ret), 9) as mean from (select sym, ret, {lag('sig', k)} as x from s) where ret is not null group by 1" for k in (1, 2, 4)))(
    lambda s, d: apply(signals(s, d), {f"x{k}": F.coalesce(bt.S.lag("sig", k), F.lit(0)) for k in (1, 2, 4)}).where("ret is not null").select("sym", "ret", F.explode(F.create_map(*[v for k in (1, 2, 4) for v in (F.lit(k), F.col(f"x{k}"))])).alias("delay", "x")).groupBy("sym", "delay").agg(F.round(F.avg(F.col("x") * F.col("ret")), 9).alias("mean"))
)
R.add("m17_kelly", "select l_orderkey, l_linenumber, round(case when p <= 0.5 then 0 else least(greatest((p * 2 - (1 - p)) / 2 / 2, 0), 0.25) end, 6) as kelly, case when abs(p - 0.5) >= 0.2 then 'HIGH' when abs(p - 0.5) >= 0.1 then 'MEDIUM' when abs(p - 0.5) >= 0.05 then 'LOW' else 'NEUTRAL' end as level from (select l_orderkey, l_linenumber, l_tax * 10 + l_discount as p from lineitem)")(
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").withColumn("p", F.col("l_tax") * 10 + F.col("l_discount")).select("l_orderkey", "l_linenumber", F.round(m.kelly(F.col("p")), 6).alias("kelly"), m.confidence(F.col("p")).alias("level"))
)
R.add("l06_split", f"with {_T}, {_N} select sym, t, case when i < floor(cnt * 0.6) then 'train' when i < floor(cnt * 0.6) + 12 then 'purge' when i < floor(cnt * 0.8) then 'val' when i < floor(cnt * 0.8) + 12 then 'purge' else 'test' end as split from n")(lambda s, d: bt.split(signals(s, d)).select("sym", "t", "split"))
_FOLDS = "ceil((cnt - 72) / 20.0)"  # as many as reach the end of the series
R.add("l06_folds", f"with {_T}, {_N}, f as (select n.*, unnest(range(0, greatest({_FOLDS}, 0)::bigint)) as fold from n) select sym, t, fold::int as fold, case when i >= 60 + fold * 20 + 12 and i < 60 + fold * 20 + 32 then 'test' else 'train' end as part from f where (i >= 60 + fold * 20 + 12 and i < 60 + fold * 20 + 32) or i < 60 + fold * 20")(lambda s, d: bt.folds(signals(s, d), 60, 20).select("sym", "t", "fold", "part"))
