"""Targets as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions.sqlkit import BARS, P, div, lag, lead, roll, staged
from tidelake.operators import targets as tg

from .base import Registry, bars4h, shown

R = Registry()
_r = {k: div(lead("c", k), "c") for k in tg.HORIZONS}
_ret = {}
for _k, _e in _r.items():
    _ret |= {f"return_log_{_k}h": f"ln(case when {_e} > 0 then {_e} end)", f"return_simple_{_k}h": f"{_e} - 1", f"return_net_{_k}h": f"{_e} - 1 - 0.0012"}
R.add("t01_returns", staged(_ret))(lambda s, d: shown(tg.returns(bars4h(s, d)), *_ret))
_fs = {f"fs_{k}": roll("stddev_samp", "fr", k) for k in (3, 6, 12)}
_sh = {f"sharpe_{k}h": f"({div(lead('c', k), 'c')} - 1) / ({lead(f'fs_{k}', k)} * sqrt({k}) + 1e-8)" for k in (3, 6, 12)}
R.add("t02_sharpe", staged({"fr": f"{div(lead('c'), 'c')} - 1"}, _fs, _sh))(lambda s, d: shown(tg.sharpe(bars4h(s, d)), *_sh))
_rk = "case when r is not null then row_number() over (partition by sym order by r asc nulls last, t) end"
R.add("t03_classes", staged({"r": f"{div(lead('c', 6), 'c')} - 1 - 0.0012"}, {"rk": _rk, "cnt": "count(r) over (partition by sym)"}, {"profitable_6h": "coalesce((r > 0)::int, 0)", "direction_6h": "case when r > 0.005 then 1 when r > -0.005 then 0 when r is not null then -1 end", "quintile_6h": "case when r is not null then 1 + " + " + ".join(f"(rk > 1 + (cnt - 1) * {k / 5})::int" for k in range(1, 5)) + " end"}))(
    lambda s, d: shown(tg.classes(bars4h(s, d)), "profitable_6h", "direction_6h", "quintile_6h")
)
_PAIRS, _HS = [(1, 2), (3, 5)], [4, 8, 24]


def _exit_sql(direction: int) -> str:
    cols, ctes = [], f"i as (select *, row_number() over ({P}) as i, count(*) over (partition by sym) as last from bars)"
    for sl, tp in _PAIRS:
        for k in _HS:
            n = f"exit_sl{sl}_tp{tp}_{k}h"
            stop = f"b.l <= a.c * (1 - {sl} / 100.0)" if direction > 0 else f"b.h >= a.c * (1 + {sl} / 100.0)"
            take = f"b.h >= a.c * (1 + {tp} / 100.0)" if direction > 0 else f"b.l <= a.c * (1 - {tp} / 100.0)"
            ctes += f", x_{n} as (select a.sym, a.t, min(b.i - a.i) filter (where {stop} or {take}) as at, arg_min(case when {stop} then -1 else 1 end, b.i) filter (where {stop} or {take}) as kind, max(b.c) filter (where b.i = a.i + {k}) as ec from i a left join i b on a.sym = b.sym and b.i between a.i + 1 and a.i + {k} group by 1, 2)"
            kind = f"(case when x_{n}.at is not null then x_{n}.kind when i.i + {k} <= i.last then 0 end)"
            cols.append(f"{kind} as {n}_type, case when x_{n}.at is not null then x_{n}.at when i.i + {k} <= i.last then {k} end as {n}_bars, round(case {kind} when -1 then -{sl} / 100.0 when 1 then {tp} / 100.0 when 0 then {direction} * (x_{n}.ec / nullif(i.c, 0) - 1) end, 6) as {n}_return")
    joins = " ".join(f"join x_exit_sl{sl}_tp{tp}_{k}h using (sym, t)" for sl, tp in _PAIRS for k in _HS)
    return f"with {BARS}, {ctes} select sym, t, {', '.join(cols)} from i {joins}"


def _exits(direction: int):
    def query(s, d):
        out = tg.exits(bars4h(s, d), _PAIRS, _HS, direction)
        cols = [c for c in out.columns if c.startswith("exit")]
        return out.select("sym", "t", *[F.round(c, 6).alias(c) if c.endswith("return") else F.col(c) for c in cols])

    return query


R.add("t04_exit_first_touch", _exit_sql(1))(_exits(1))
R.add("t04_exit_first_touch_short", _exit_sql(-1))(_exits(-1))
# the whole grid of stops, takes and horizons, one row each
_SLS, _TPS, _FAR = (1.0, 2.0, 3.0), (1.5, 2.0, 3.0, 5.0), (4, 8, 24, 48, 168)
_GRID = f"""with {BARS}, i as (select *, row_number() over ({P}) as i, count(*) over (partition by sym) as last from bars),
ab as (select a.sym, a.t, a.c, b.i - a.i as d, b.h, b.l, b.c as bc from i a join i b on a.sym = b.sym and b.i between a.i + 1 and a.i + {max(_FAR)}),
ss as (select sym, t, sl, min(d) as at from ab, (select unnest({list(_SLS)}::double[]) as sl) where l <= c * (1 - sl / 100) group by 1, 2, 3),
tt as (select sym, t, tp, min(d) as at from ab, (select unnest({list(_TPS)}::double[]) as tp) where h >= c * (1 + tp / 100) group by 1, 2, 3),
g as (select i.sym, i.t, i.i, i.last, i.c, sl, tp, k::int as k, ss.at as s, tt.at as w, e.bc from i cross join (select unnest({list(_SLS)}::double[]) as sl) x cross join (select unnest({list(_TPS)}::double[]) as tp) y cross join (select unnest({list(_FAR)}) as k) z
  left join ss using (sym, t, sl) left join tt using (sym, t, tp) left join ab e on e.sym = i.sym and e.t = i.t and e.d = k),
r as (select *, case when s <= k and (w is null or s <= w) then -1 when w <= k and (s is null or w < s) then 1 when i + k <= last then 0 end as kind from g)
select sym, t, sl, tp, k, kind, case kind when -1 then s when 1 then w when 0 then k end::int as bars, round(case kind when -1 then -sl / 100 when 1 then tp / 100 when 0 then bc / nullif(c, 0) - 1 end, 6) as ret from r"""


@R.add("t04_exit_grid", _GRID)
def _(s, d):
    out = tg.exits(bars4h(s, d), [(sl, tp) for sl in _SLS for tp in _TPS], list(_FAR))
    name = lambda sl, tp, k: f"`exit_sl{sl:g}_tp{tp:g}_{k}h"
    cell = lambda sl, tp, k: F.struct(F.lit(sl).alias("sl"), F.lit(tp).alias("tp"), F.lit(k).alias("k"), F.col(name(sl, tp, k) + "_type`").alias("kind"), F.col(name(sl, tp, k) + "_bars`").alias("bars"), F.round(name(sl, tp, k) + "_return`", 6).alias("ret"))
    return out.select("sym", "t", F.inline(F.array(*[cell(sl, tp, k) for sl in _SLS for tp in _TPS for k in _FAR])))


_va = {f"return_vol_adj_{k}h": f"({div(lead('c', k), 'c')} - 1) / ({roll('stddev_samp', 'br', 24)} + 1e-8)" for k in (6, 12)}
R.add("t05_vol_adjusted", staged({"br": f"{div('c', lag('c'))} - 1"}, _va))(lambda s, d: shown(tg.vol_adjusted(bars4h(s, d)), *_va))
_ah = lambda k: f"over ({P} rows between 1 following and {k} following)"
_ex = {}
for _k in (4, 8, 24, 48):
    _ex |= {f"mae_{_k}h": f"case when count(c) {_ah(_k)} = {_k} then 100 * (min(l) {_ah(_k)} / nullif(c, 0) - 1) end", f"mfe_{_k}h": f"case when count(c) {_ah(_k)} = {_k} then 100 * (max(h) {_ah(_k)} / nullif(c, 0) - 1) end"}
R.add("t06_excursions", staged(_ex, {k: k for k in _ex} | {f"mfe_mae_ratio_{k}h": f"mfe_{k}h / (abs(mae_{k}h) + 0.01)" for k in (4, 8)}))(lambda s, d: shown(tg.excursions(bars4h(s, d)), *_ex, "mfe_mae_ratio_4h", "mfe_mae_ratio_8h"))
_dir = "case when r > 0.005 then 1.0 when r > -0.005 then 0.0 when r is not null then -1.0 end"


def _frame(seconds: int) -> str:
    return f"(select sym, t, {_dir} as dir from (select sym, t, {div(lead('c', 6), 'c')} - 1 - 0.0012 as r from (select sym, (t // {seconds}) * {seconds} as t, arg_max(c, t) as c from bars group by 1, 2)))"


R.add("t07_alignment", f"with {BARS}, a as {_frame(28800)}, b as {_frame(86400)}, j as (select x.sym, x.t, a.dir as p from bars x asof left join a on x.sym = a.sym and x.t >= a.t), k as (select j.sym, j.t, j.p, b.dir as q from j asof left join b on j.sym = b.sym and j.t >= b.t) select sym, t, (coalesce(p, 0) + coalesce(q, 0)) / nullif((p is not null)::int + (q is not null)::int, 0) as tf_alignment_6h from k")(
    lambda s, d: tg.aligned(bars4h(s, d)).select("sym", "t", "tf_alignment_6h")
)
_cl = lambda e, a, b: f"least(greatest({e}, {a}), {b})"
R.add("t08_entry_quality", f"with {BARS}, r as (select sym, ({div(lead('c', 6), 'c')} - 1) / 1000 as r from bars), g as (select sym, count(r) as n, avg((r > 0)::int) as w, coalesce(avg(r) filter (where r > 0), 0) as aw, coalesce(avg(r) filter (where r < 0), 0) as al, avg(r) / stddev_samp(r) * sqrt(count(r) / 90.0 * 365) as sh from r where r is not null group by 1) select sym, round(0.3 * {_cl('abs(aw / al) * w / (1 - w + 1e-8)', 0, 10)} / 10 + 0.3 * {_cl('sh', -3, 3)} / 3 + 0.2 * {_cl('(w * aw + (1 - w) * al) * 100', -10, 10)} / 10 + 0.2 * least(1, n / 100.0), 6) as score from g where n >= 30")(
    lambda s, d: tg.returns(bars4h(s, d), (6,)).withColumn("r", F.col("return_simple_6h") / 1000).where("r is not null").groupBy("sym").agg(F.round(tg.entry_quality(F.col("r")), 6).alias("score")).where("score > double('-inf')")
)
R.add("t09_learning_target", staged({"target_return": f"{div(lead('c', 6), 'c')} - 1", "target_up": f"({div(lead('c', 6), 'c')} - 1 > 0)::int"}))(lambda s, d: shown(tg.learning_target(bars4h(s, d)), "target_return", "target_up"))
