"""Streams, alerts and reports as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions.sqlkit import BARS, P
from tidelake.operators import search as rs
from tidelake.sources import connectors as cn
from tidelake.sources.store import shared_folder
from tidelake.streaming import live, scanner

from . import report
from .base import Registry, bars4h, table
from .rule_queries import _GREEDY, _fired, _with_ret, flagship, flagship_sql

R = Registry()
_BARS = "select event_type as sym, (epoch_us(ts) // 14400000000) * 14400 as t, arg_min(value, (ts, event_id)) as o, max(value) as h, min(value) as l, arg_max(value, (ts, event_id)) as c, count(*)::double as v from events group by 1, 2"
R.add("st1_stream_bars", f"select * from ({_BARS}) where t + 14400 <= (select max(epoch_us(ts)) / 1e6 from events) - 3600")(lambda s, d: _streamed(s, d))


def _streamed(s, d):
    at = shared_folder(s, "st1")
    events = table(s, d, "events")
    events.write.parquet(f"{at}/in")
    live.run_once(live.stream_bars(live.event_stream(s, f"{at}/in", events.schema)), f"{at}/out", f"{at}/state")
    return s.read.parquet(f"{at}/out")


_GATE = f"with recursive {BARS}, a as (select sym, t, c as score, row_number() over ({P}) as i from bars where c >= 50), k as (select sym, t, score, i, true as keep, t as last from a where i = 1 union all select a.sym, a.t, a.score, a.i, a.t - k.last >= 28800, case when a.t - k.last >= 28800 then a.t else k.last end from a join k on a.sym = k.sym and a.i = k.i + 1) select sym, t, score from k where keep"


@R.add("st2_stream_cooldown", _GATE)
def _(s, d):
    at = shared_folder(s, "st2")
    bars4h(s, d).where("c >= 50").select("sym", "t", F.col("c").alias("score")).write.parquet(f"{at}/in")
    src = s.readStream.schema("sym string, t long, score double").parquet(f"{at}/in")
    live.run_once(live.cooled(src, 8 * 3600), f"{at}/out", f"{at}/state")
    return s.read.parquet(f"{at}/out")


@R.add("st3_sessions", "with e as (select user_id, epoch_us(ts) as u, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as p from events), g as (select *, sum((p is null or u - p >= 1800000000)::int) over (partition by user_id order by u rows unbounded preceding) as k from e), x as (select user_id, k, min(u) as a, max(u) as b, count(*) as n from g group by 1, 2) select user_id, a // 1000000 as t, n from x where b + 1800000000 <= (select max(u) from e) - 3600000000")
def _(s, d):
    at = shared_folder(s, "st3")
    events = table(s, d, "events")
    events.write.parquet(f"{at}/in")
    live.run_once(live.session_counts(live.event_stream(s, f"{at}/in", events.schema)), f"{at}/out", f"{at}/state")
    return s.read.parquet(f"{at}/out")


@R.add("st4_unique_events", "select count(*) as n, count(distinct event_id) as ids, round(sum(value), 4) as total from events")
def _(s, d):
    at = shared_folder(s, "st4")
    events = table(s, d, "events")
    for k in range(2):  # every event arrives twice
        events.write.parquet(f"{at}/in{k}")
    twice = s.readStream.schema(events.schema).parquet(f"{at}/in*").withColumn("ts", F.col("ts").cast("timestamp"))
    live.run_once(live.unique_events(twice, late="10000 days"), f"{at}/out", f"{at}/state")
    return s.read.parquet(f"{at}/out").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


@R.add("st5_batches", "select event_type as sym, count(*) as n, case when avg(value) > 50 then 'LONG' else 'SHORT' end || ' ' || event_type || ' (' || printf('%.2f', avg(value)) || ')' as said from events group by 1")
def _(s, d):
    at = shared_folder(s, "st5")
    events = table(s, d, "events")
    events.write.parquet(f"{at}/in")
    seen = live.event_stream(s, f"{at}/in", events.schema).groupBy(F.col("event_type").alias("sym")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    live.each_batch(seen, lambda df, k: df.write.mode("overwrite").parquet(f"{at}/out"), f"{at}/state", "complete")
    out = s.read.parquet(f"{at}/out")
    return out.select("sym", "n", live.message(F.col("sym"), F.col("mean") - 50, F.col("mean")).alias("said"))


_SCAN = f"""with recursive {BARS.replace('bars as', 'every as', 1)}, bars as (select * from every where t + 14400 <= (select max(epoch_us(ts)) / 1e6 from events) - 3600),
x as (select sym, t, c, v::bigint as n, case when count(c) over ({P} rows 11 preceding) = 12 then avg(c) over ({P} rows 11 preceding) end as mean, case when count(c) over ({P} rows 11 preceding) = 12 then stddev_samp(c) over ({P} rows 11 preceding) end as sd from bars),
y as (select *, case when sd > 0 then (c - mean) / sd end as score from x), a as (select sym, t, row_number() over ({P}) as i from y where abs(score) >= 1.5),
k as (select sym, t, i, true as keep, t as last from a where i = 1 union all select a.sym, a.t, a.i, a.t - k.last >= 28800, case when a.t - k.last >= 28800 then a.t else k.last end from a join k on a.sym = k.sym and a.i = k.i + 1)
select y.sym, y.t, round(c, 6) as c, n, round(mean, 6) as mean, round(score, 6) as score, coalesce(keep, false) as alert from y left join k using (sym, t)"""


@R.add("st6_scanner", _SCAN)
def _(s, d):
    """Bars, rolling scores and alerts with a cooldown, all from the state of one stream."""
    at, conf = shared_folder(s, "st6"), "spark.sql.streaming.stateStore.providerClass"
    events = table(s, d, "events")
    events.write.parquet(f"{at}/in")
    before = s.conf.get(conf)
    s.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live.run_once(scanner.scanned(live.event_stream(s, f"{at}/in", events.schema), back=12, cooldown=8 * 3600), f"{at}/out", f"{at}/state")
    finally:
        s.conf.set(conf, before)
    out = s.read.parquet(f"{at}/out")
    known = lambda c: F.when(~F.isnan(c), F.round(c, 6)).alias(c)
    return out.select("sym", "t", F.round("c", 6).alias("c"), "n", known("mean"), known("score"), "alert")


_SURE = f"with {BARS} select sym, t, round(c, 6) as c from bars where c >= 50"


@R.add("s21_alert_sink", _SURE)
def _(s, d):
    """Confident bars of a paged stream, published by a sink in two steps; the second run goes on from the first one's offset."""
    at = shared_folder(s, "s21")
    cn.register(s)
    bars = bars4h(s, d)
    cn.write_pages(bars, f"{at}/pages", 86400)
    t = bars.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    o = {"folder": f"{at}/pages", "symbols": ",".join(r.sym for r in bars.select("sym").distinct().collect()), "start": t.a, "step": 86400, "rate": 10_000}  # one row for each symbol
    for end in ((t.a + t.b) // 2, t.b + 86400):
        sure = cn.parsed(s.readStream.format("feed_pages").options(**o, end=end).load()).where("c >= 50").select("sym", "t", "c")
        sure.writeStream.format("alert_sink").option("path", f"{at}/alerts").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return cn.alerts(s, f"{at}/alerts", "sym string, t long, c double").select("sym", "t", F.round("c", 6).alias("c"))


R.add("s21_alert_gate", _GATE)(lambda s, d: live.gated(bars4h(s, d), "c", 50.0, 8 * 3600))


_TABLES = {"events": "ts", "orders": "o_orderdate", "customer": None, "lineitem": "l_shipdate"}
_DATA = " union all ".join(f"select '{n}' as source, count(*)::bigint as rows, {f'(epoch_us(min({t})) // 1000000)::bigint' if t else 'null::bigint'} as start, {f'(epoch_us(max({t})) // 1000000)::bigint' if t else 'null::bigint'} as end_ from {n}" for n, t in _TABLES.items())
_ENTRY = f"""g0 as (select sym, indicator, op, pct, count(*) as support, avg((ret > 0)::int) as win, any_value(threshold) as threshold from k where keep group by 1, 2, 3, 4 having count(*) >= 10),
g as (select *, case when win >= 0.5 then win else 1 - win end as confidence from g0 where win >= 0.5 or win <= 0.5 order by confidence desc, support desc, sym, indicator, op, pct limit 50),
er as (select sym, indicator || ' ' || op || ' ' || printf('%.4f', threshold) as rule, case when win >= 0.5 then 'LONG' else 'SHORT' end as direction, support, win, confidence from g)"""
_LINES = f"""with recursive {BARS}, {_fired('c, v')}, {_GREEDY}, {_ENTRY}, dt as ({_DATA}),
ls as (select 1 as part, row_number() over (order by source) as i, '  source: ' || source || ', rows: ' || rows || ', start: ' || coalesce(start::varchar, '') || ', end: ' || coalesce(end_::varchar, '') as line from dt
union all select 2, row_number() over (order by confidence desc, support desc, sym, rule), '  sym: ' || sym || ', rule: ' || rule || ', direction: ' || direction || ', support: ' || support || ', win: ' || printf('%.4f', win) || ', confidence: ' || printf('%.4f', confidence) || ', verdict: UNKNOWN' from er)
select part::int as part, i::int as i, line from ls"""


@R.add("s09_report", _LINES)
def _(s, d):
    """Every line of the data and rule sections of a discovery report, as its text form shows them."""
    tables = {n: (table(s, d, n), t) for n, t in _TABLES.items()}
    mined = rs.mine(_with_ret(s, d), ["c", "v"], min_trades=10, min_win=0.5)
    body, _, _ = report.discovery("Discovery", {"data": report.acquisition(tables), "rules": report.entry_rules(mined)})
    out, part = [], 0
    for line in body.split("\n"):
        if line in ("data", "rules"):
            part, i = part + 1, 0
        elif line.startswith("  "):
            i += 1
            out.append((part, i, line))
    return s.createDataFrame(out, "part int, i int, line string")


@R.add("s09b_fields", "select 'exit_sl' || p_size || '_tp' || (p_size * 2) || '_' || (p_size % 24 + 1) || 'h' as rule, p_size::double as stop, p_size * 2.0::double as take, p_size % 24 + 1 as bars from part")
def _(s, d):
    rule = F.concat(F.lit("exit_sl"), F.col("p_size"), F.lit("_tp"), F.col("p_size") * 2, F.lit("_"), F.col("p_size") % 24 + 1, F.lit("h")).alias("rule")
    return report.exit_fields(table(s, d, "part").select(rule), "rule")


@R.add("s09b_cards", f"""{flagship_sql()} select sym, oos, '        rule: ' || sym || chr(10) || '           n: ' || n_trades || chr(10) || '        mean: ' || printf('%.4f', mean_return) || chr(10) || '     verdict: ' as card from final""")
def _(s, d):
    return report.cards(flagship(s, d).withColumnsRenamed({"n_trades": "n", "mean_return": "mean"}).withColumns({"rule": F.col("sym"), "verdict": F.lit(None).cast("string")})).select("sym", "oos", "card")
