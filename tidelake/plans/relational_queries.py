"""Sources, projections, joins, aggregates, sorts and sets as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.sqlkit import BARS, P, div, lag, staged
from tidelake.functions.windows import Series, corr
from tidelake.operators import bars as B
from tidelake.operators import features as ft
from tidelake.operators.rowops import Condition, Rule, avoid, by_position, fill_median, long_format, matching, numeric
from tidelake.sources import connectors as cn
from tidelake.sources import feeds, macro, plot
from tidelake.sources.orchestrator import Orchestrator
from tidelake.sources.store import Store, shared_folder

from .base import DAILY, Registry, bars4h, daily, shown, table

R = Registry()
S = Series("sym", "t")


def r6(e, name: str):
    return F.round(e.cast("double") if not isinstance(e, str) else F.col(e).cast("double"), 6).alias(name)


# sources and sinks
R.add("s01_parquet_read", "select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_discount >= 0.09 and l_quantity < 5")(
    lambda s, d: table(s, d, "lineitem").where("l_discount >= 0.09 and l_quantity < 5").select("l_orderkey", "l_linenumber", "l_extendedprice")
)


@R.add("s02_parquet_write", "select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by 1")
def _(s, d):
    st = Store(s, shared_folder(s, "s02"))
    st.save(table(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "customer", by=["c_mktsegment"])
    return st.load("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@R.add("s03_latest", "select max((epoch_us(o_orderdate) // 86400000000) * 86400) as latest, 1::bigint as tables, false as missing from orders")
def _(s, d):
    st = Store(s, shared_folder(s, "s03"))
    st.save(daily(s, d), "daily")
    return s.createDataFrame([(st.latest("daily"), len(st.names()), st.exists("nothing"))], "latest long, tables long, missing boolean")


_TWO = "a as (select sym, t, c as a from bars where v > 10), b as (select sym, t, o as b from bars where v <= 12)"
R.add("s04_column_concat", f"with {BARS}, {_TWO} select sym, t, a, b from a full join b using (sym, t)")(
    lambda s, d: B.outer_on_time([bars4h(s, d).where("v > 10").select("sym", "t", F.col("c").alias("a")), bars4h(s, d).where("v <= 12").select("sym", "t", F.col("o").alias("b"))], ["sym", "t"])
)


@R.add("s05_feature_cache", staged({"x": f"{div('c', lag('c'))} - 1"}))
def _(s, d):
    st = Store(s, shared_folder(s, "s05"))
    build = lambda: shown(ft.apply(bars4h(s, d), {"x": S.pct_change("c")}), "x")
    st.cached("features", build)
    return st.cached("features", build)


@R.add("s06_csv", "select n_nationkey, n_name, n_regionkey from nation")
def _(s, d):
    st = Store(s, shared_folder(s, "s06"))
    st.save_csv(table(s, d, "nation"), "nation")
    return st.load_csv("nation", "n_nationkey int, n_name string, n_regionkey int")


@R.add("s07_json", "select s_suppkey, case when s_acctbal >= 0 then s_acctbal end as bal from supplier")
def _(s, d):
    st = Store(s, shared_folder(s, "s07"))
    st.save_json(table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).otherwise(float("nan")).alias("bal")), "supplier")
    return st.load_json("supplier", "s_suppkey long, bal double")


@R.add("s11_klines_feed", f"with {BARS} select sym, count(*) as n, round(sum(c), 4) as close, round(sum(v - tb), 4) as sells, round(avg(tb / nullif(v, 0)), 6) as ratio from bars group by 1")
def _(s, d):
    """Bars as pages of a feed, read page by page at a limited rate."""
    folder = f"{shared_folder(s, 's11')}/pages"
    bars = bars4h(s, d)
    cn.register(s)
    cn.write_pages(bars, folder, 5 * 86400)
    t = bars.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    names = ",".join(r.sym for r in bars.select("sym").distinct().collect())  # one row for each symbol
    pages = s.read.format("feed_pages").options(folder=folder, symbols=names, start=t.a, end=t.b + 1, step=5 * 86400, rate=1000).load()
    k = feeds.kline_columns(cn.parsed(pages).withColumnsRenamed({"v": "volume", "tb": "taker_buy_volume"}))
    return k.groupBy("sym").agg(F.count("*").alias("n"), F.round(F.sum("c"), 4).alias("close"), F.round(F.sum("taker_sell_volume"), 4).alias("sells"), F.round(F.avg("taker_buy_ratio"), 6).alias("ratio"))


R.add("s12_order_book", f"with {BARS} select sym, t, round((v - tb) / nullif(v + tb, 0), 6) as imbalance, round(h - l, 6) as spread, round((h + l) / 2, 6) as mid_price from bars")(
    lambda s, d: shown(feeds.order_book(bars4h(s, d), "v", "tb", "l", "h"), "imbalance", "spread", "mid_price")
)
R.add("s14_payload_keys", "select event_id, coalesce(case when (props::json->>'k') not in ('0', '') then props::json->>'k' end, props::json->>'q') as k from events")(
    lambda s, d: table(s, d, "events").select("event_id", feeds.first_key(F.col("props"), "k", "q").alias("k"))
)


def _ohlc(s, d) -> DataFrame:
    """Bars as JSON, on even hours under long keys, else under short ones."""
    long_ = F.to_json(F.struct(F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close")))
    return bars4h(s, d).select("sym", "t", F.when(F.col("t") % 28800 == 0, long_).otherwise(F.to_json(F.struct("o", "h", "l", "c"))).alias("payload"))


R.add("s14_ohlc_payload", f"with {BARS} select sym, t, round(nullif(o, 0), 6) as oi_open, round(nullif(h, 0), 6) as oi_high, round(nullif(l, 0), 6) as oi_low, round(nullif(c, 0), 6) as oi_close from bars")(lambda s, d: shown(feeds.ohlc_payload(_ohlc(s, d), "payload", "oi"), "oi_open", "oi_high", "oi_low", "oi_close"))
R.add("s15_long_short", f"with {BARS} select sym, t, round(v / nullif(tb, 0), 6) as ls_long_short_ratio from bars")(lambda s, d: shown(feeds.long_short(bars4h(s, d), "v", "tb", "ls_"), "ls_long_short_ratio"))
R.add("s15_liquidation_payload", f"with {BARS} select sym, t, round(tb + v, 6) as total_liq_usd, round(v / nullif(tb + v, 0), 6) as liq_ratio, round(v / (tb + 1), 6) as liq_ratio_v2, round(v - tb, 6) as net_liq from bars")(
    lambda s, d: shown(feeds.liquidations(bars4h(s, d), "v", "tb"), "total_liq_usd", "liq_ratio", "liq_ratio_v2", "net_liq")
)
R.add("s15_taker_payload", f"with {BARS} select sym, t, round(v / nullif(tb, 0), 6) as taker_buy_sell_ratio, round(v - tb, 6) as net_taker_flow, round((v - tb) / nullif(v + tb, 0) * 100, 6) as taker_delta_pct from bars")(
    lambda s, d: shown(feeds.taker_flow(bars4h(s, d), "v", "tb"), "taker_buy_sell_ratio", "net_taker_flow", "taker_delta_pct")
)
_DX = "exp_ as (select sym, t, last_value(a ignore nulls) over (partition by sym order by t) as a, last_value(b ignore nulls) over (partition by sym order by t) as b from (select sym, t, a, b from (select sym, t, c - 150000 as a from bars where v > 1) full join (select sym, t, c - 160000 as b from bars where v <= 2) using (sym, t)))"
R.add("s16_yield_curve", f"with {DAILY}, {_DX} select sym, t, round(a, 4) as a, round(b, 4) as b, a < 0 as a_inverted, b < 0 as b_inverted, round(a - b, 4) as real_yield from exp_")(
    lambda s, d: macro.real_yield(macro.yield_curve([daily(s, d).where("v > 1").select("sym", "t", (F.col("c") - 150000).alias("a")), daily(s, d).where("v <= 2").select("sym", "t", (F.col("c") - 160000).alias("b"))], ["a", "b"]), "a", "b").select("sym", "t", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "a_inverted", "b_inverted", F.round("real_yield", 4).alias("real_yield"))
)
R.add("s16_inflation", staged({"c_yoy": f"({div('c', lag('c', 12))} - 1) * 100"}, head=DAILY))(lambda s, d: shown(macro.inflation(daily(s, d), "c"), "c_yoy"))
_CN = "exp_ as (select sym, t, last_value(a ignore nulls) over (partition by sym order by t) as a, last_value(b ignore nulls) over (partition by sym order by t) as b from (select sym, t, a, b from (select sym, t, c - 150000 as a from bars where v > 1) full join (select sym, t, 160000 - c as b from bars where v <= 2) using (sym, t)))"
R.add("s16_conditions", f"with {DAILY}, {_CN} select sym, t, round(a, 4) as a, round(b, 4) as b, a > 0 as a_tight, b > 0 as b_tight, a < 0 as a_loose, b < 0 as b_loose from exp_")(
    lambda s, d: macro.conditions([daily(s, d).where("v > 1").select("sym", "t", (F.col("c") - 150000).alias("a")), daily(s, d).where("v <= 2").select("sym", "t", (160000 - F.col("c")).alias("b"))], ["a", "b"]).select("sym", "t", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "a_tight", "b_tight", "a_loose", "b_loose")
)
R.add("s16_metadata", f"with {DAILY} select 'all' as series, count(*) as rows, count(c) as known, min(t) as first, max(t) as last from bars union all select 'busy', count(*), count(case when c > 150000 then c end), min(t), max(t) from bars where v > 1")(
    lambda s, d: macro.metadata({"all": daily(s, d), "busy": daily(s, d).where("v > 1").withColumn("c", F.when(F.col("c") > 150000, F.col("c")))})
)


def _aggregates(s, d) -> DataFrame:
    """A payload of bars for each series, as an aggregates API answers."""
    one = F.struct((F.col("t") * 1000).alias("t"), "o", "h", "l", "c", "v", F.when(F.col("v") > 9, F.col("n") / F.col("v")).alias("vw"))
    return bars4h(s, d).groupBy("sym").agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("results"))).alias("payload"))  # an answer of the API holds a page of bars


R.add("s17_equity_aggregates", f"with {BARS} select sym, t, o as open, h as high, l as low, c as close, v as volume, round(case when v > 9 then n / v end, 6) as vwap from bars")(
    lambda s, d: feeds.equity_aggregates(_aggregates(s, d), "payload", ["sym"]).select("sym", F.unix_seconds("timestamp").alias("t"), "open", "high", "low", "close", "volume", F.round("vwap", 6).alias("vwap"))
)
R.add("s17_previous_close", f"with {BARS} select sym, c as close, v as volume from bars qualify row_number() over (partition by sym order by t) = 1")(lambda s, d: feeds.previous_close(_aggregates(s, d), "payload", ["sym"]).select("sym", "close", "volume"))
R.add("s17_market_status", "select n_nationkey, n_name as market, r_name as exchange from nation join region on n_regionkey = r_regionkey")(
    lambda s, d: feeds.market_status(table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("market"), F.create_map(F.lit("first"), "r_name").alias("exchanges"))).alias("payload")), "payload", ["n_nationkey"]).select("n_nationkey", "market", F.col("exchanges")["first"].alias("exchange"))
)


@R.add("s19_orchestrator", f"with {BARS}, last as (select max(t) as m from bars), b as (select * from bars, last where t > m - 20 * 86400), dl as ({DAILY[len('bars as ('):-1]}) select 'price' as category, '4h' as name, 20 as days, count(*) as rows, min(t) as first, max(t) as last, 2::bigint as built from b union all select 'macro', 'prices', 365, count(*), min(t), max(t), 2 from dl")
def _(s, d):
    built = []

    def price(days):
        built.append("price")
        b = bars4h(s, d)
        return b.join(F.broadcast(b.agg(F.max("t").alias("m"))), F.col("t") > F.col("m") - days * 86400).drop("m")  # one row

    def prices(days):
        built.append("macro")
        return daily(s, d)

    at = Orchestrator(Store(s, shared_folder(s, "s19")), {"price": {"4h": price}, "macro": {"prices": prices, "nothing": lambda days: daily(s, d).limit(0)}})
    at.fetch_all({"price": 20})
    at.fetch_all({"price": 20})  # from the cache
    return at.metadata().withColumn("built", F.lit(len(built)).cast("long"))


@R.add("s08_equity_png", None)
def _(s, d):
    """A picture for each series."""
    return plot.pictures(daily(s, d), "c")


R.add("s18_fear_greed", f"with {BARS} select sym, t, case when c < 25 then 'Extreme Fear' when c < 45 then 'Fear' when c <= 55 then 'Neutral' when c <= 75 then 'Greed' else 'Extreme Greed' end as fear_greed_class, c < 25 as fg_extreme_fear, c > 75 as fg_extreme_greed, c < 45 as fg_fear, c > 55 as fg_greed from bars")(
    lambda s, d: feeds.fear_greed(bars4h(s, d), "c").select("sym", "t", "fear_greed_class", "fg_extreme_fear", "fg_extreme_greed", "fg_fear", "fg_greed")
)
_NAME = "'BTC-' || p_brand || '-' || (p_size * 1000)::varchar || case when p_partkey % 3 = 0 then '-P' when p_partkey % 7 = 1 then '' else '-C' end"


def _options(s, d) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "-P").when(F.col("p_partkey") % 7 == 1, "").otherwise("-C")
    named = table(s, d, "part").select("p_partkey", F.concat(F.lit("BTC-"), "p_brand", F.lit("-"), (F.col("p_size") * 1000).cast("string"), kind).alias("name"), F.col("p_retailprice").alias("oi"), (F.col("p_size") / 10).alias("iv"))
    return feeds.instrument(named, "name")


_OPT = f"n as (select p_partkey, {_NAME} as name, p_retailprice as oi, p_size / 10.0 as iv, string_split({_NAME}, '-') as p from part), i as (select p_partkey, name, oi, iv, case when len(p) = 4 then p[2] end as expiry, case when len(p) = 4 then try_cast(p[3] as double) end as strike, case when len(p) = 4 then p[4] end as kind from n)"
R.add("s18_instruments", f"with {_OPT} select p_partkey, expiry, strike, kind from i")(lambda s, d: _options(s, d).select("p_partkey", "expiry", "strike", "kind"))
R.add("a06_option_metrics", f"with {_OPT}, m as (select sum(oi) filter (where kind = 'C') as a, sum(oi) filter (where kind = 'P') as b, sum(iv * oi) / sum(oi) as avg_iv, count(*) as total_options from i) select round(a, 2) as call_oi, round(b, 2) as put_oi, round(b / a, 6) as put_call_ratio, round(avg_iv, 6) as avg_iv, total_options from m")(
    lambda s, d: feeds.option_metrics(_options(s, d)).select(F.round("call_oi", 2).alias("call_oi"), F.round("put_oi", 2).alias("put_oi"), F.round("put_call_ratio", 6).alias("put_call_ratio"), F.round("avg_iv", 6).alias("avg_iv"), "total_options")
)
R.add("a05_max_pain", f"with {_OPT}, g as (select strike, sum(oi) as oi from i where strike is not null group by 1) select strike as max_pain, round(oi, 2) as oi from g order by g.oi desc, strike limit 1")(
    lambda s, d: feeds.max_pain(_options(s, d).where("strike is not null")).select("max_pain", F.round("oi", 2).alias("oi"))
)


# projections and filters
R.add("p01_prefix", f"with {BARS} select sym, t, o as px_o, c as px_c from bars")(lambda s, d: B.prefixed(bars4h(s, d).select("sym", "t", "o", "c"), "px_", ["sym", "t"]))
R.add("p02_numeric_columns", "select p_partkey, p_size, p_retailprice from part")(lambda s, d: (t := table(s, d, "part")).select(*numeric(t)))
R.add("p03_columns_by_pattern", "select l_orderkey, l_partkey, l_suppkey from lineitem")(lambda s, d: (t := table(s, d, "lineitem")).select(*matching(t, r"^l_.*key$")))
_HOLES = "case when c > 60 then c end as a, case when o > 40 then o end as b, case when h > 90 then h end as x"


def _holes(s, d) -> DataFrame:
    return bars4h(s, d).select("sym", "t", F.expr("case when c > 60 then c end as a"), F.expr("case when o > 40 then o end as b"), F.expr("case when h > 90 then h end as x"))


R.add("p04_drop_sparse_rows", f"with {BARS}, g as (select sym, t, {_HOLES} from bars) select * from g where 2 + (a is not null)::int + (b is not null)::int + (x is not null)::int >= 4")(lambda s, d: _holes(s, d).dropna(thresh=4))
R.add("p05_drop_empty_rows", f"with {BARS}, g as (select sym, t, {_HOLES} from bars) select * from g where a is not null or b is not null or x is not null")(lambda s, d: _holes(s, d).dropna("all", subset=["a", "b", "x"]))
R.add("p06_keep_last", "select l_orderkey, arg_max(l_extendedprice, l_linenumber) as price, max(l_linenumber) as l_linenumber from (select l_orderkey, l_linenumber, max(l_extendedprice) as l_extendedprice from lineitem group by 1, 2) group by 1")(
    lambda s, d: B.keep_one(table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price")), ["l_orderkey"], "l_linenumber").select("l_orderkey", "price", "l_linenumber")
)
R.add("p06_keep_first", "select l_orderkey, min(l_linenumber) as l_linenumber, arg_min(l_extendedprice, l_linenumber) as price from (select l_orderkey, l_linenumber, max(l_extendedprice) as l_extendedprice from lineitem group by 1, 2) group by 1")(
    lambda s, d: B.keep_one(table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price")), ["l_orderkey"], "l_linenumber", last=False).select("l_orderkey", "price", "l_linenumber")
)
_RULES = [Rule("a", (Condition("c", ">", 60.0),)), Rule("b", (Condition("c", "<=", 30.0), Condition("v", ">=", 12.0)), direction="SHORT"), Rule("m", (Condition("none", ">", 0.0),)), Rule("u", (Condition("c", "~", 0.0),)), Rule("e", (Condition("v", "==", 10.0), Condition("o", "between", (20.0, 40.0))), logic="OR")]
R.add("p07_rule_predicates", f"with {BARS} select sym, t, (c > 60) as a, (c <= 30 and v >= 12) as b, false as m, true as u, (v = 10 or o between 20 and 40) as e from bars")(lambda s, d: (b := bars4h(s, d)).select("sym", "t", *[r.column(b.columns).alias(r.name) for r in _RULES]))
R.add("p09_rule_signal", f"with {BARS} select sym, t, case when c > 60 then 1 else 0 end as a, case when c <= 30 and v >= 12 then -1 else 0 end as b from bars")(lambda s, d: (b := bars4h(s, d)).select("sym", "t", *[r.signal(b.columns).alias(r.name) for r in _RULES[:2]]))
R.add("p10_avoid_filter", f"with {BARS} select sym, t, c from bars where not (c > 60) and not (v = 10 or o between 20 and 40)")(
    lambda s, d: (b := bars4h(s, d)).where(avoid([(_RULES[0], 0.9, 0.5), (_RULES[4], 0.8, 0.5), (_RULES[1], 0.1, 0.1)], b.columns, top=2)).select("sym", "t", "c")
)
R.add("p11_conditional_assign", f"with {BARS} select sym, t, case when c > 60 then 1 when c < 30 then -1 else 0 end as x from bars")(lambda s, d: bars4h(s, d).select("sym", "t", F.when(F.col("c") > 60, 1).when(F.col("c") < 30, -1).otherwise(0).alias("x")))
_FB = f"coalesce(last_value(a ignore nulls) over ({P} rows between unbounded preceding and current row), first_value(a ignore nulls) over ({P} rows between current row and unbounded following), 0)"
R.add("p13_fill", f"with {BARS}, g as (select sym, t, {_HOLES} from bars) select sym, t, {_FB} as a from g")(lambda s, d: B.fill(_holes(s, d).select("sym", "t", "a"), ["a"], back=True, zero=True))
R.add("p14_fill_median", f"with {BARS}, g as (select sym, t, {_HOLES} from bars) select sym, t, round(coalesce(a, (select median(a) from g)), 6) as a from g")(lambda s, d: fill_median(_holes(s, d), ["a"]).select("sym", "t", r6("a", "a")))

# joins
_CN = "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
R.add("j01_left_join", "select c_custkey, o_orderkey from customer left join (select * from orders where o_totalprice > 400000) on c_custkey = o_custkey")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey"))
R.add("j02_full_outer_fill", f"with {BARS}, {_TWO}, f as (select sym, t, a, b from a full join b using (sym, t)) select sym, t, last_value(a ignore nulls) over ({P} rows unbounded preceding) as a, last_value(b ignore nulls) over ({P} rows unbounded preceding) as b from f")(
    lambda s, d: macro.composite([bars4h(s, d).where("v > 10").select("sym", "t", F.col("c").alias("a")), bars4h(s, d).where("v <= 12").select("sym", "t", F.col("o").alias("b"))], ["a", "b"])
)
_SPARSE = "r as (select sym, t + 3600 as t, case when c > 40 then c end as x from bars where v > 11)"


def _sparse(s, d) -> DataFrame:
    return bars4h(s, d).where("v > 11").select("sym", (F.col("t") + 3600).alias("t"), F.expr("case when c > 40 then c end as x"))


R.add("j03_asof_join", f"with {BARS}, {_SPARSE} select b.sym, b.t, b.c, r.x from bars b asof left join r on b.sym = r.sym and b.t >= r.t")(lambda s, d: B.asof(bars4h(s, d).select("sym", "t", "c"), _sparse(s, d), ["sym"]))
R.add("j04_asof_forward", f"with {BARS}, {_SPARSE} select b.sym, b.t, b.c, r.x from bars b asof left join r on b.sym = r.sym and b.t <= r.t")(lambda s, d: B.asof(bars4h(s, d).select("sym", "t", "c"), _sparse(s, d), ["sym"], forward=True))
R.add("j05_inner_on_time", f"with {BARS}, {_TWO} select sym, t, a, b from a join b using (sym, t)")(lambda s, d: bars4h(s, d).where("v > 10").select("sym", "t", F.col("c").alias("a")).join(bars4h(s, d).where("v <= 12").select("sym", "t", F.col("o").alias("b")), ["sym", "t"]))
R.add("j06_positional_join", f"with {BARS}, l as (select sym, t, c, row_number() over ({P}) as i from bars), r as (select sym, o, row_number() over ({P}) as i from bars where v > 11) select l.sym, l.t, l.c, r.o from l join r using (sym, i)")(lambda s, d: by_position(bars4h(s, d).select("sym", "t", "c"), bars4h(s, d).where("v > 11").select("sym", "t", "o"), ["sym"], "t").select("sym", "t", "c", "o"))
R.add("j07_concat_suffix", f"with {BARS} select l.sym, l.t, l.c, r.c as c_right from bars l left join (select * from bars where v > 11) r using (sym, t)")(lambda s, d: bars4h(s, d).select("sym", "t", "c").join(bars4h(s, d).where("v > 11").select("sym", "t", F.col("c").alias("c_right")), ["sym", "t"], "left"))
R.add("j08_path_range", f"with {BARS}, i as (select *, row_number() over ({P}) as i from bars) select a.sym, a.t, max(b.h) as mx, min(b.l) as mn, count(*) as n from i a join i b on a.sym = b.sym and b.i between a.i + 1 and a.i + 6 group by 1, 2")(
    lambda s, d: bars4h(s, d).select("sym", "t", F.max("h").over(S.ahead(6)).alias("mx"), F.min("l").over(S.ahead(6)).alias("mn"), F.count("*").over(S.ahead(6)).alias("n")).where("n > 0")
)
R.add("j09_parameter_product", f"with {BARS}, u as (unpivot (select sym, t, c, o from bars) on c, o into name indicator value value), p as (select unnest([20.0, 50.0, 80.0]) as th) select indicator, th, count(*) filter (where value > th) as n from u, p group by 1, 2")(
    lambda s, d: long_format(bars4h(s, d), ["sym", "t"], ["c", "o"]).join(F.broadcast(s.createDataFrame([(20.0,), (50.0,), (80.0,)], "th double"))).groupBy("indicator", "th").agg(F.count_if(F.col("value") > F.col("th")).alias("n"))
)
R.add("j10_lookup_join", f"select n_name, r_name, count(*) as n, round(sum(c_acctbal), 2) as bal from {_CN} group by 1, 2")(
    lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))
)
R.add("j11_semi_join", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"))
R.add("j12_anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"))
_MASTER = f"""with {BARS}, {_SPARSE}, q as (select sym, t + 7200 as t, o as y from bars where v > 13),
j as (select b.sym, b.t, b.c, r.x as fund_x, q.y as oi_y from bars b asof left join r on b.sym = r.sym and b.t >= r.t asof left join q on b.sym = q.sym and b.t >= q.t),
f as (select sym, t, c, last_value(fund_x ignore nulls) over ({P} rows between 24 preceding and current row) as fund_x, last_value(oi_y ignore nulls) over ({P} rows between 24 preceding and current row) as oi_y from j)
select * from f where 3 + (fund_x is not null)::int + (oi_y is not null)::int >= 4"""
R.add("j13_master_table", _MASTER)(lambda s, d: B.master(bars4h(s, d).select("sym", "t", "c"), {"fund": _sparse(s, d), "oi": bars4h(s, d).where("v > 13").select("sym", (F.col("t") + 7200).alias("t"), F.col("o").alias("y"))}, share=0.8))

# aggregates
R.add("a01_resample", f"with {BARS}, g as (select sym, (t // 86400) * 86400 as t, arg_max(c, t) as c, arg_min(o, t) as o, round(avg(h), 6) as h, sum(v) as v from bars group by 1, 2) select * from g")(
    lambda s, d: B.resample(bars4h(s, d), B.DAY, {"c": "last", "o": "first", "h": "mean", "v": "sum"}).withColumn("h", F.round("h", 6))
)
R.add("a02_time_floor", "select event_id, (epoch_us(ts) // 900000000) * 900 as t from events")(lambda s, d: table(s, d, "events").select("event_id", B.floor_time(B.epoch("ts"), B.FREQUENCIES["15m"]).alias("t")))
R.add("a03_timeline", f"with {BARS} select sym, unnest(range((min(t) // 3600) * 3600, max(t) + 1, 3600)) as t from bars group by 1")(lambda s, d: B.timeline(bars4h(s, d), B.HOUR))
R.add("a04_scalar_stats", "select round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as lo, max(value) as hi, count(value) as n, median(value) as med, count(distinct value) as uniq, round(avg((value is null)::int) * 100, 6) as null_pct from events")(
    lambda s, d: table(s, d, "events").agg(r6(F.avg("value"), "mean"), r6(F.stddev_samp("value"), "std"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"), F.percentile("value", 0.5).alias("med"), F.count_distinct("value").alias("uniq"), r6(F.avg(F.col("value").isNull().cast("int")) * 100, "null_pct"))
)
_Q = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
R.add("a07_percentiles", "select event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) as p{int(q * 100)}" for q in _Q) + " from events group by 1")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(*[r6(F.percentile("value", q), f"p{int(q * 100)}") for q in _Q]))
R.add("a08_ddof", "select event_type, round(stddev_pop(value), 6) as s0, round(stddev_samp(value), 6) as s1 from events group by 1")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(r6(F.stddev_pop("value"), "s0"), r6(F.stddev_samp("value"), "s1")))
R.add("a09_correlation", f"with {BARS} select sym, round(corr(c, o), 6) as co, round(corr(c, v), 6) as cv from bars group by 1")(lambda s, d: bars4h(s, d).groupBy("sym").agg(r6(corr("c", "o"), "co"), r6(corr("c", "v"), "cv")))
_SK = "select event_type, avg(value) as m, stddev_pop(value) as s from events group by 1"
R.add("a10_moments", f"select event_type, round(avg(power((value - m) / s, 3)), 6) as skew, round(avg(power((value - m) / s, 4)) - 3, 6) as kurt from events join ({_SK}) using (event_type) group by 1")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(r6(F.skewness("value"), "skew"), r6(F.kurtosis("value"), "kurt")))
R.add("a11_var_shortfall", f"with {BARS}, r as (select sym, {div('c', lag('c'))} - 1 as r from bars), q as (select sym, quantile_cont(r, 0.05) as q from r group by 1) select sym, round(any_value(q), 6) as var95, round(avg(r) filter (where r <= q), 6) as es from r join q using (sym) group by 1")(
    lambda s, d: var_shortfall(ft.apply(bars4h(s, d), {"r": S.pct_change("c")}))
)


def var_shortfall(df: DataFrame) -> DataFrame:
    q = df.groupBy("sym").agg(F.percentile("r", 0.05).alias("q"))
    return df.join(q, "sym").groupBy("sym").agg(r6(F.first("q"), "var95"), r6(F.avg(F.when(F.col("r") <= F.col("q"), F.col("r"))), "es"))


_SMALL = "l_discount - 0.05"
R.add("a12_compound", f"select l_returnflag, round(exp(sum(ln(1 + ({_SMALL}) / 1000))) - 1, 6) as total from lineitem group by 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(r6(F.product(1 + (F.col("l_discount") - 0.05) / 1000) - 1, "total")))
R.add("a13_win_rate", f"select l_returnflag, round(sum(({_SMALL} > 1e-9)::int)::double / nullif(sum((abs({_SMALL}) > 1e-9)::int), 0), 6) as no_zeros, round(avg(({_SMALL} > 1e-9)::int), 6) as with_zeros from lineitem group by 1")(
    lambda s, d: table(s, d, "lineitem").withColumn("r", F.col("l_discount") - 0.05).groupBy("l_returnflag").agg(r6(F.try_divide(F.count_if(F.col("r") > 1e-9), F.count_if(F.abs("r") > 1e-9)), "no_zeros"), r6(F.avg((F.col("r") > 1e-9).cast("int")), "with_zeros"))
)
R.add("a14_profit_factor", f"select l_returnflag, round(sum({_SMALL}) filter (where {_SMALL} > 0) / abs(sum({_SMALL}) filter (where {_SMALL} < 0)), 6) as pf from lineitem group by 1")(
    lambda s, d: table(s, d, "lineitem").withColumn("r", F.col("l_discount") - 0.05).groupBy("l_returnflag").agg(r6(F.try_divide(F.sum(F.when(F.col("r") > 0, F.col("r"))), F.abs(F.sum(F.when(F.col("r") < 0, F.col("r"))))), "pf"))
)
R.add("a15_value_counts", "select o_orderpriority, count(*) as n from orders group by 1")(lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")))
_REQ = [("events", 1000), ("orders", 10**9), ("nothing", 1)]


@R.add("a17_coverage_audit", "select * from (values ('events', 1000::bigint, (select count(*) from events), (select count(*) from events) >= 1000), ('orders', 1000000000, (select count(*) from orders), false), ('nothing', 1, 0, false)) v(name, needed, n, ok)")
def _(s, d):
    counts = table(s, d, "events").agg(F.lit("events").alias("name"), F.count("*").alias("n")).unionByName(table(s, d, "orders").agg(F.lit("orders").alias("name"), F.count("*").alias("n")))
    need = s.createDataFrame(_REQ, "name string, needed long")
    return need.join(counts, "name", "left").select("name", "needed", F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.coalesce("n", F.lit(0)) >= F.col("needed")).alias("ok"))


_EDGE = [0.0, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 1.0]
_CASE = "case " + " ".join(f"when p >= {a} and p < {b} then {i}" for i, (a, b) in enumerate(zip(_EDGE, _EDGE[1:], strict=False))) + " end"


def _predictions(s, d) -> DataFrame:
    return table(s, d, "lineitem").select((F.col("l_quantity") / 50).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


_PRED = "pr as (select l_quantity / 50 as p, (l_returnflag = 'R')::int as y from lineitem)"
R.add("a18_calibration_bins", f"with {_PRED} select {_CASE} as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate from pr where p < 1 group by 1 having count(*) >= 5")(
    lambda s, d: _predictions(s, d).where("p < 1").groupBy(F.expr(_CASE).alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("p"), "mean_p"), r6(F.avg("y"), "rate")).where("n >= 5")
)
R.add("a18_equal_bins", f"with {_PRED} select floor(p * 10)::int as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate, round(abs(avg(p) - avg(y)), 6) as gap from pr where p < 1 group by 1")(
    lambda s, d: _predictions(s, d).where("p < 1").groupBy(F.floor(F.col("p") * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("p"), "mean_p"), r6(F.avg("y"), "rate"), r6(F.abs(F.avg("p") - F.avg("y")), "gap"))
)
_BAND = "case when p >= 0.7 or p <= 0.3 then 'high' when p >= 0.6 or p <= 0.4 then 'medium' when p >= 0.55 or p <= 0.45 then 'low' else 'neutral' end"
R.add("a19_confidence_bands", f"with {_PRED} select {_BAND} as band, count(*) as n, round(avg(((p > 0.5)::int = y)::int), 6) as accuracy from pr group by 1")(lambda s, d: _predictions(s, d).groupBy(F.expr(_BAND).alias("band")).agg(F.count("*").alias("n"), r6(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("int")), "accuracy")))
_PC = "least(greatest(p, 1e-15), 1 - 1e-15)"
R.add("a20_classification", f"""with {_PRED}, k as (select sum((p > 0.5 and y = 1)::int) as tp, sum((p > 0.5 and y = 0)::int) as fp, sum((p <= 0.5 and y = 1)::int) as fn, sum((p <= 0.5 and y = 0)::int) as tn,
  avg(-(y * ln({_PC}) + (1 - y) * ln(1 - {_PC}))) as ll, avg(power(p - y, 2)) as brier from pr),
u as (select sum(rk) filter (where y = 1) as s, sum(y) as n1, count(*) - sum(y) as n0 from (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rk from pr))
select tp, fp, fn, tn, round((tp + tn)::double / (tp + fp + fn + tn), 6) as accuracy, round(tp::double / (tp + fp), 6) as prec, round(tp::double / (tp + fn), 6) as recall, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1, round(ll, 6) as log_loss, round(brier, 6) as brier, round((s - n1 * (n1 + 1) / 2.0) / (n1::double * n0), 6) as auc from k, u""")(lambda s, d: classification(_predictions(s, d)))


def classification(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, log-loss, Brier and exact AUC (from counts per distinct score)."""
    P_, Y = F.col(p), F.col(y)
    q = F.least(F.greatest(P_, F.lit(1e-15)), F.lit(1 - 1e-15))
    hit = lambda a, b: F.count_if((P_ > 0.5 if a else P_ <= 0.5) & (Y == b))
    k = df.agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"), F.avg(-(Y * F.ln(q) + (1 - Y) * F.ln(1 - q))).alias("ll"), F.avg((P_ - Y) ** 2).alias("brier"))
    by = df.groupBy(p).agg(F.sum(Y).alias("n1"), F.sum(1 - Y).alias("n0"))  # distinct scores, not rows
    # negatives below each score: sums of 10,001 score ranges in order, then an order within each range
    by = by.withColumn("part", F.floor(P_ * 10_000))
    parts = by.groupBy("part").agg(F.sum("n0").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.join(parts.select("part", before.alias("before")), "part")
    inside = F.sum("n0").over(Window.partitionBy("part").orderBy(p).rowsBetween(Window.unboundedPreceding, -1))
    below = F.col("before") + F.coalesce(inside, F.lit(0))
    u = by.select("n1", "n0", (F.col("n1") * (below + F.col("n0") / 2)).alias("w")).agg(F.try_divide(F.sum("w"), F.sum("n1").cast("double") * F.sum("n0")).alias("auc"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return k.join(F.broadcast(u)).select("tp", "fp", "fn", "tn", r6((tp + tn) / (tp + fp + fn + tn), "accuracy"), r6(F.try_divide(tp, tp + fp), "prec"), r6(F.try_divide(tp, tp + fn), "recall"), r6(F.try_divide(2 * tp, 2 * tp + fp + fn), "f1"), r6("ll", "log_loss"), r6("brier", "brier"), r6("auc", "auc"))


R.add("a21_distinct_gate", f"with {BARS} select sym, count(distinct c) > 5 as many, count(distinct v) as n from bars group by 1")(lambda s, d: bars4h(s, d).groupBy("sym").agg((F.count_distinct("c") > 5).alias("many"), F.count_distinct("v").alias("n")))

# sorts, limits, sets, scalars
R.add("o1_top_n", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20")(lambda s, d: table(s, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_acctbal"))
R.add("o2_multi_key_sort", "select c_mktsegment, c_acctbal, c_custkey, row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) as i from customer qualify i <= 50")(
    lambda s, d: table(s, d, "customer").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(50).select("c_mktsegment", "c_acctbal", "c_custkey", F.row_number().over(Window.orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")).cast("long").alias("i"))
)
R.add("u1_union_dedup", "select c_nationkey as k from customer union select s_nationkey from supplier")(lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct())
R.add("u2_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier where s_acctbal > 9000")(lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"))))
R.add("u3_except", "select c_nationkey as k from customer except select s_nationkey from supplier where s_acctbal > 9000")(lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(s, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"))))
R.add("v1_scalars", "select p_partkey, round(ln(p_retailprice), 6) as ln_, round(sqrt(p_size), 6) as sq, sign(p_size - 25)::int as sg, lower(p_type) as lo, substr(p_brand, 1, 5) as sub, string_split(p_brand, '#')[2] as part, replace(p_name, ' ', '_') as rep, round(exp(p_size / 50.0), 6) as ex, contains(p_name, 'red') as has from part")(
    lambda s, d: table(s, d, "part").select("p_partkey", r6(F.ln("p_retailprice"), "ln_"), r6(F.sqrt("p_size"), "sq"), F.signum(F.col("p_size") - 25).cast("int").alias("sg"), F.lower("p_type").alias("lo"), F.substring("p_brand", 1, 5).alias("sub"), F.split("p_brand", "#")[1].alias("part"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("rep"), r6(F.exp(F.col("p_size") / 50), "ex"), F.contains("p_name", F.lit("red")).alias("has"))
)
R.add("v2_try_cast", "select o_orderkey, try_cast(substr(o_orderpriority, 1, 1) as double) as x, try_cast(o_orderstatus as double) as y from orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("double").alias("x"), feeds.fred_value("o_orderstatus").alias("y")))
