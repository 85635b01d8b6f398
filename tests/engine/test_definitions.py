"""Definitions against pandas and numpy, written from what each name means; nothing of the library but the operators is used."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelake.operators import backtest as bt
from tidelake.operators import features as ft
from tidelake.operators import metrics as m
from tidelake.operators import search as rs
from tidelake.operators import targets as tg
from tidelake.operators import validation as vd
from tidelake.operators.rowops import Condition, Rule

BAR = 14400


def frame(n=300, seed=0):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    o = np.r_[c[0], c[:-1]]
    h, l = np.maximum(o, c) * (1 + rng.random(n) * 0.01), np.minimum(o, c) * (1 - rng.random(n) * 0.01)  # noqa: E741
    return pd.DataFrame({"sym": "a", "t": np.arange(n) * BAR, "o": o, "h": h, "l": l, "c": c, "v": rng.integers(1, 100, n).astype(float), "x": rng.normal(0, 1, n).cumsum()})


@pytest.fixture(scope="module")
def bars(spark):
    p = frame()
    return p, spark.createDataFrame(p)


def column(df, name):
    return np.array([math.nan if r[0] is None else float(r[0]) for r in df.orderBy("sym", "t").select(name).collect()])


def same(got, want, tol=1e-8):
    want = np.asarray(want, float)
    assert (np.isnan(got) == np.isnan(want)).all(), (np.flatnonzero(np.isnan(got) != np.isnan(want))[:5], got[:5], want[:5])
    assert np.allclose(got, want, rtol=tol, atol=tol, equal_nan=True)


def stage(df, stages):
    return ft.apply(df, *stages)


def test_rsi(bars):
    p, df = bars
    d = p.c.diff()
    up, down = d.where(d > 0, 0.0), (-d).where(d < 0, 0.0)
    out = ft.rsi(df, (6, 14))
    for k in (6, 14):
        g, s = up.ewm(span=k, adjust=False).mean(), down.ewm(span=k, adjust=False).mean()
        want = 100 - 100 / (1 + g / (s + 1e-10))
        same(column(out, f"price_rsi_{k}"), want, 1e-6)
        same(column(out, f"price_rsi_{k}_oversold"), (want < 30).astype(int))


def test_recursive_means(bars):
    p, df = bars
    out = ft.ema_features(df, (6, 8, 12, 13, 180))
    for k in (6, 180):
        same(column(out, f"price_ema_{k}"), p.c.ewm(span=k).mean())


def test_volume(bars):
    p, df = bars
    out = stage(df, ft.volume())
    tp = (p.h + p.l + p.c) / 3
    vwap = (tp * p.v).rolling(6).sum() / p.v.rolling(6).sum()
    same(column(out, "price_volume_trend_5"), p.v.rolling(5).mean().diff())
    same(column(out, "price_vwap_6c"), vwap)
    same(column(out, "price_vwap_dist"), p.c / vwap - 1)


def test_levels(bars):
    p, df = bars
    same(column(stage(df, ft.open_interest("v")), "v_accel"), p.v.diff().diff())
    same(column(stage(df, ft.conditions("x")), "x_loose"), (p.x < 0).astype(int))
    y = pd.Series(np.tile([5, 20, 39, 40, 59.5, 60, 79, 80, 81, 90], 30)[: len(p)])
    fg = stage(df.sparkSession.createDataFrame(p.assign(y=y.values)), ft.fear_greed("y"))
    for name, mask in {"extreme_fear": y < 20, "fear": (y >= 20) & (y < 40), "neutral": (y >= 40) & (y < 60), "greed": (y >= 60) & (y < 80), "extreme_greed": y >= 80}.items():
        same(column(fg, f"y_{name}"), mask.astype(int))
    run, want = 0, []
    for v in y:
        run = run + 1 if v < 20 or v > 80 else 0
        want.append(run)
    same(column(fg, "y_days_at_extreme"), want)


def test_interactions(bars):
    p, df = bars
    div = stage(df, ft.divergences(["x"]))
    s6, s48 = p.shift(6), p.shift(48)
    same(column(div, "x_bull_div"), ((p.l < s6.l) & (s6.l < s48.l) & (p.x > s6.x) & (s6.x < s48.x)).astype(int))
    same(column(div, "x_bear_div"), ((p.h > s6.h) & (s6.h > s48.h) & (p.x < s6.x) & (s6.x > s48.x)).astype(int))
    r6, oi = p.c / p.c.shift(6) - 1, p.v.pct_change()
    got = stage(df, [{"oi": ft.S.pct_change("v"), "r6": ft.S.pct_change("c", 6)}, *ft.oi_price("oi", "r6", "x")])
    same(column(got, "oi_price_div"), ((oi > 0) & (r6 < 0)).astype(int))
    high = p.x > p.x.rolling(42).mean() + p.x.rolling(42).std()
    same(column(got, "funding_price_div"), (high & (r6 < 0)).astype(int))
    got = stage(df, [{"y_oversold": F.lit(1), "y_overbought": F.lit(0), "rsi": F.col("v"), "ratio": F.lit(2.5)}, *ft.crowding("rsi", ["y"], "ratio")])
    same(column(got, "rsi_overbought_vol_spike"), (p.v > 70).astype(int))
    same(column(got, "multi_oversold"), 1 + (p.v < 30).astype(int))
    z = stage(df, ft.short_z(["x"]))
    for k, least in ((20, 5), (50, 10)):
        same(column(z, f"x_z{k}"), (p.x - p.x.rolling(k, least).mean()) / (p.x.rolling(k, least).std() + 1e-10))
    assert ft.lagged_columns(["price_rsi_14", "price_rsi_6", "f_funding_zscore_168h", "oi_change_1h", "fear_greed_value", "price_bb_position_20"]) == ["price_rsi_14", "price_bb_position_20", "f_funding_zscore_168h", "oi_change_1h", "fear_greed_value"]


def test_targets(bars):
    p, df = bars
    r = p.c.shift(-6) / p.c - 1
    fr = p.c.pct_change().shift(-1)
    same(column(tg.sharpe(df, (6,)), "sharpe_6h"), r / (fr.rolling(6).std().shift(-6) * math.sqrt(6) + 1e-8))
    net = r - 0.0012
    k = tg.classes(df)
    same(column(k, "profitable_6h"), (net > 0).astype(int))
    same(column(k, "direction_6h"), pd.cut(net, [-np.inf, -0.005, 0.005, np.inf], labels=[-1, 0, 1]).astype(float))
    same(column(k, "quintile_6h"), pd.qcut(net.rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(float))
    vol = p.c.pct_change().rolling(24).std()
    same(column(tg.vol_adjusted(df, (6,)), "return_vol_adj_6h"), r / (vol + 1e-8), 1e-6)
    ex = tg.excursions(df, (4,))
    n = len(p)
    mfe = [(p.h[i + 1 : i + 5].max() / p.c[i] - 1) * 100 if i + 4 < n else np.nan for i in range(n)]
    mae = [(p.l[i + 1 : i + 5].min() / p.c[i] - 1) * 100 if i + 4 < n else np.nan for i in range(n)]
    same(column(ex, "mfe_4h"), mfe)
    same(column(ex, "mae_4h"), mae)
    same(column(ex, "mfe_mae_ratio_4h"), np.array(mfe) / (np.abs(mae) + 0.01))


def test_alignment(bars):
    p, df = bars
    want = []
    for seconds in (2 * BAR, 6 * BAR):
        g = p.groupby(p.t // seconds * seconds).c.last()
        net = g.shift(-6) / g - 1 - 0.0012
        d = pd.cut(net, [-np.inf, -0.005, 0.005, np.inf], labels=[-1, 0, 1]).astype(float)
        want.append(d.reindex(p.t, method="ffill").values)
    with np.errstate(all="ignore"):
        mean = pd.DataFrame(want).T.mean(axis=1)
    same(column(tg.aligned(df), "tf_alignment_6h"), mean)


def test_entry_quality(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0.002, 0.01, 60)
    w, aw, al = (r > 0).mean(), r[r > 0].mean(), r[r < 0].mean()
    pf = abs(aw / al) * (w / (1 - w + 1e-8))
    sharpe = r.mean() / r.std(ddof=1) * math.sqrt(60 / 90 * 365)
    want = 0.3 * min(max(pf, 0), 10) / 10 + 0.3 * min(max(sharpe, -3), 3) / 3 + 0.2 * min(max((w * aw + (1 - w) * al) * 100, -10), 10) / 10 + 0.2 * 0.6
    df = spark.createDataFrame([(float(x),) for x in r], "r double")
    assert df.agg(tg.entry_quality(F.col("r"))).first()[0] == pytest.approx(want)
    assert df.limit(29).agg(tg.entry_quality(F.col("r"))).first()[0] == -math.inf


def test_costs(spark):
    assert bt.round_trip() == pytest.approx(0.001275)
    want = {"optimistic": 2 * 0.0003 + 0.75 * 0.00005, "base": 0.001275, "pessimistic": 2 * 0.0009 + 0.75 * 0.00015, "high_volume": 2 * 0.0006 + 0.75 * 0.0001}
    r = np.array([0.01, -0.004, 0.006, 0.002, -0.001, 0.004])
    got = {x.scenario: x for x in bt.scenarios(spark.createDataFrame([("a", float(x), 12.0) for x in r], "sym string, r double, days double")).collect()}
    for name, cost in want.items():
        net = r - cost
        daily = (1 + np.prod(1 + net) - 1) ** (1 / 12) - 1
        assert got[name].cost == pytest.approx(cost) and got[name].net_return == pytest.approx(np.prod(1 + net) - 1)
        assert got[name].net_sharpe == pytest.approx(daily / (net.std() * math.sqrt(6 / 12)) * math.sqrt(365))


def test_time_exit_of_six_bars(spark):
    """One short trade held six bars, entered and left at closes."""
    p = frame(12, 5)
    p["sig"] = [0, -1] + [0] * 10
    got = bt.trade_log(spark.createDataFrame(p), cost=0.001275).collect()
    gross = -(p.c[7] / p.c[1] - 1)
    assert [(x.side, x.entry, x.exit) for x in got] == [(-1, p.c[1], p.c[7])]
    assert got[0].gross == pytest.approx(gross) and got[0].net == pytest.approx(gross - 0.001275)


def test_votes_and_rolling_signals(spark, bars):
    rows = spark.createDataFrame([(0, 1, 1, -1), (1, 1, 0, 0), (2, -1, -1, 1), (3, 1, 1, 1), (4, -1, -1, -1)], "t int, a int, b int, x int")
    got = rows.select("t", rs.combine(["a", "b", "x"]).alias("una"), rs.combine(["a", "b", "x"], False).alias("maj")).orderBy("t").collect()
    assert [r.una for r in got] == [0, 0, 0, 1, -1] and [r.maj for r in got] == [1, 0, -1, 1, -1]
    p, df = bars
    k = max(20, min(500, len(p) // 3))
    lo, hi = (p.x.rolling(k, min_periods=20).quantile(q) for q in (0.2, 0.8))
    z = (p.x - p.x.rolling(k, min_periods=20).mean()) / (p.x.rolling(k, min_periods=20).std() + 1e-10)
    got = rs.recent(df, "x", "xs").select("sym", "t", rs.rolling_percentile(F.col("x"), F.col("xs"), 0.2, 0.8).alias("p"), rs.rolling_z(F.col("x"), F.col("xs"), -1.5, 1.5).alias("z"))
    same(column(got, "p"), np.where(p.x > hi, 1, np.where(p.x < lo, -1, 0)))
    same(column(got, "z"), np.where(z > 1.5, 1, np.where(z < -1.5, -1, 0)))
    short = p[:15]
    got = rs.recent(spark.createDataFrame(short), "x", "xs").select("sym", "t", rs.rolling_percentile(F.col("x"), F.col("xs"), 0.2, 0.8).alias("p"))
    lo, hi = (short.x.expanding(min_periods=10).quantile(q) for q in (0.2, 0.8))
    same(column(got, "p"), np.where(short.x > hi, 1, np.where(short.x < lo, -1, 0)))


def test_loss_patterns(spark):
    rng = np.random.default_rng(1)
    p = frame(600, 2)
    p["atr"] = rng.random(600)
    p["ret"] = np.where(p.atr > np.quantile(p.atr, 0.8), -np.abs(rng.normal(size=600)), rng.normal(size=600))
    got = {r.pattern: r for r in rs.loss_patterns(spark.createDataFrame(p), ["atr", "x"]).collect()}
    high = p.ret[p.atr > np.quantile(p.atr, 0.8)]
    assert got["atr>80"].n == len(high) and got["atr>80"].loss_rate == 1.0 and got["atr>80"].mean_loss == pytest.approx(high.mean())
    assert got["atr>80"].frequency == pytest.approx(len(high) / 600)
    assert "atr<20" not in got and all(r.n >= 50 and r.loss_rate >= 0.6 and r.confidence > 0.8 for r in got.values())
    tree = Rule("loss_leaf", (Condition("atr", ">", 0.9),))
    assert "loss_leaf" in {r.pattern for r in rs.loss_patterns(spark.createDataFrame(p), ["x"], rules=[tree]).collect()}


def test_regimes(spark):
    rng = np.random.default_rng(4)
    p = frame(400, 3)
    p["vol"] = rng.random(400)
    p["ret"] = np.where(p.vol > np.quantile(p.vol, 0.75), -1.0, np.where(np.arange(400) % 100 < 47, 1.0, -1.0))
    got = {r.regime: r for r in rs.market_regimes(spark.createDataFrame(p), "vol", "x", "v").collect()}
    for name, mask in {"high_vol": p.vol > np.quantile(p.vol, 0.75), "low_vol": p.vol <= np.quantile(p.vol, 0.25), "strong_trend": p.x > p.x.median(), "low_liquidity": p.v <= np.quantile(p.v, 0.25)}.items():
        win = (p.ret[mask] > 0).mean()
        assert got[name].n == mask.sum() and got[name].win == pytest.approx(win) and got[name].frequency == pytest.approx(mask.mean())
        assert got[name].recommendation == ("avoid" if win < 0.45 else "reduce_size" if win < 0.5 else "trade")
    assert got["high_vol"].recommendation == "avoid"


def greedy(signal, holding=6):
    keep, free = np.zeros(len(signal), bool), 0
    for i, s in enumerate(signal):
        if s != 0 and i >= free:
            keep[i], free = True, i + holding
    return keep


def test_critic(spark):
    rng = np.random.default_rng(7)
    n = 3000
    p = frame(n, 6)
    p["good"] = rng.normal(size=n)
    p["ret"] = np.where(p.good > 0.5, 0.004, 0.0) + rng.normal(0, 0.005, n)
    p["half"] = np.where(np.arange(n) < n * 0.7, p.good, np.nan)
    p["time_hour"] = p.good
    p["volume"] = p.good
    p["reg"] = np.where(np.arange(n) % 3 == 0, "u", np.where(np.arange(n) % 3 == 1, "v", "w"))
    rules = [Rule(f, (Condition(f, ">", 0.5),)) for f in ("good", "half", "time_hour", "volume", "next_good")] + [Rule("wrong", (Condition("good", ">", 0.5),), direction="SHORT")]
    df = spark.createDataFrame(p.astype({"half": object}).where(p.notna(), None), "sym string, t long, o double, h double, l double, c double, v double, x double, good double, ret double, half double, time_hour double, volume double, reg string")
    got = {r.rule: r for r in rs.critique(df, rules, regime="reg").collect()}
    s = (p.good > 0.5).astype(int)
    keep = greedy(s)
    r = p.ret[keep]
    g = got["good"]
    assert g.n == keep.sum() and g.mean == pytest.approx(r.mean())
    i, cut = np.flatnonzero(keep), int(n * 0.8)
    quarters = sum(p.ret[keep & (np.arange(n) // (n // 4) == q)].mean() > 0 for q in range(4))
    assert g.quarters == quarters and g.early_n == (i < int(n * 0.7)).sum()
    tail = np.zeros(n, bool)
    tail[cut:] = greedy(s[cut:].values)
    early, late = p.ret[keep & (np.arange(n) < cut)], p.ret[tail]
    sharpe = lambda x, days: x.mean() / (x.std(ddof=1) + 1e-10) * math.sqrt(len(x) / days * 365)
    assert g.is_sharpe == pytest.approx(sharpe(early, cut / 6)) and g.oos_sharpe == pytest.approx(sharpe(late, (n - cut) / 6))
    stable = sum(len(x := p.ret[greedy((p.good > 0.5 * (1 + d)).astype(int))]) >= 10 and x.mean() > 0 for d in (-0.1, -0.05, -0.02, 0.02, 0.05, 0.1))
    regimes = sum((keep & (p.reg == k)).sum() >= 10 and p.ret[keep & (p.reg == k)].mean() > 0 for k in "uvw")
    assert g.stable == stable and g.regimes == regimes == 3
    assert g.verdict == "CREDIBLE" and got["time_hour"].verdict == "DEBUNKED" and got["wrong"].verdict == "DEBUNKED"
    assert got["half"].coverage == pytest.approx(0.7) and not got["half"].ok_coverage and not got["half"].ok_out_of_sample
    assert not got["volume"].ok_economic_name and got["volume"].ok_lookahead and not got["next_good"].ok_lookahead and got["next_good"].n == 0
    assert rs.critique(df.drop("reg"), rules[:1]).first().regimes >= 2


def figures(sig, ret, days, cost=0.0012):
    r = sig * ret - cost * (sig != 0)
    t = r[sig != 0]
    if len(t) < 5:
        return dict.fromkeys(("sharpe", "total", "dd", "win"), 0.0) | {"n": 0, "p": 1.0}
    eq = np.cumprod(1 + r)
    sd = t.std(ddof=1)
    return {"n": len(t), "sharpe": t.mean() / sd * math.sqrt(len(t) / days * 365) if sd > 0 else 0.0, "total": eq[-1] - 1, "dd": (eq / np.maximum.accumulate(eq) - 1).min(), "win": (t > 0).mean()}


def test_validation(spark):
    rng = np.random.default_rng(8)
    n = 1200
    p = frame(n, 9)
    p["ret"] = rng.normal(0.0, 0.01, n)
    p["sig"] = np.where(rng.random(n) < 0.3, np.sign(p.ret + rng.normal(0, 0.02, n)), 0.0)
    row = vd.validate(spark.createDataFrame(p), vol="v", trend="x").first()
    keep = greedy(p.sig)
    sig, ret = np.where(keep, p.sig, 0.0), p.ret.values
    walk = []
    for k in range(3):
        a, b = k * 400, (k + 1) * 400
        cut = a + int(400 * 0.7)
        parts = [(sig[i:j], ret[i:j]) for i, j in ((a, cut), (cut, b))]
        walk.append([figures(np.where(greedy(s), s, 0.0), r, max(1, len(s) // 6)) for s, r in parts])
    oos = [w[1] for w in walk]
    total = sum(o["n"] for o in oos)
    assert row.n_trades == total and row.sharpe == pytest.approx(sum(o["sharpe"] * o["n"] for o in oos) / total)
    assert row.win_rate == pytest.approx(sum(o["win"] * o["n"] for o in oos) / total) and row.max_drawdown == pytest.approx(min(0, *(o["dd"] for o in oos)))
    sharpes = [o["sharpe"] for o in oos]
    assert row.wf_consistency == pytest.approx(1 - min(1, np.std(sharpes) / (abs(np.mean(sharpes)) + 1e-8)))
    bad = sum(w[0]["sharpe"] > 0 and (w[0]["sharpe"] - w[1]["sharpe"]) / w[0]["sharpe"] > 0.5 for w in walk)
    assert row.degradation_rate == pytest.approx(1 - bad / 3)
    first, second = figures(sig[:600], ret[:600], 100), figures(sig[600:], ret[600:], 100)
    assert row.time_stability == pytest.approx(max(0, 1 - abs(second["sharpe"] - first["sharpe"]) / (abs(first["sharpe"]) + 1e-8)))
    for d in (1, 2, 4):
        late = figures(np.r_[np.zeros(d), sig[:-d]], ret, 200)
        assert row[f"delay_{d}"] == pytest.approx(max(0, late["sharpe"] / (first["sharpe"] + 1e-8)))
    t = sig[sig != 0] * ret[sig != 0]
    assert row["cost_2x_sharpe"] == pytest.approx((t.mean() - 0.0024) / (t.std(ddof=1) + 1e-8) * math.sqrt(len(t) / 90 * 365), rel=1e-4)
    low = (p.v <= p.v.median()).values
    assert row.regimes["low_volatility"] == pytest.approx(figures(sig[low], ret[low], max(1, low.sum() // 6))["sharpe"])
    assert set(row.regimes) == {"low_volatility", "high_volatility", "ranging", "trending"}
    few = vd.validate(spark.createDataFrame(p[:100])).first()
    assert few.grade == "F" and few.recommendation == "FAILED" and few.warnings == ["too little data"]


def test_grades(spark):
    cases = [((2.5, 0.56, -0.05, True, 0.01, 1.0), "A"), ((1.2, 0.53, -0.12, False, 0.08, 0.5), "C"), ((0.2, 0.4, -0.5, False, 0.5, 0.0), "F"), ((11.0, 0.9, -0.01, True, 0.0, 1.0), "F"), ((2.5, 0.56, -0.05, True, 0.01, 0.0), "A"), ((1.6, 0.51, -0.16, True, 0.01, 0.5), "B")]
    df = spark.createDataFrame([c for c, _ in cases], "s double, w double, d double, k boolean, p double, r double")
    got = [r[0] for r in df.select(m.grade(*[F.col(c) for c in "swdkpr"])).collect()]
    assert got == [g for _, g in cases]


def test_random_strategies(spark):
    rng = np.random.default_rng(10)
    p = frame(400, 11)
    p["ret"] = rng.normal(0, 0.01, 400)
    p["sig"] = np.where(np.arange(400) % 8 == 0, np.sign(p.ret), 0.0)  # knows the future
    row = vd.monte_carlo(spark.createDataFrame(p), runs=300).first()
    own = (p.sig * p.ret)[p.sig != 0]
    assert row.n_trades == 50 and row.runs == 300 and row.better_than_random and row.sharpe_percentile == 100.0
    assert row.actual_sharpe == pytest.approx(own.mean() / (own.std() + 1e-8) * math.sqrt(50 / 90 * 365)) and abs(row.random_mean) < 3
    p["sig"] = np.where(np.arange(400) % 8 == 0, 1.0, 0.0)
    chance = vd.monte_carlo(spark.createDataFrame(p), runs=300).first()
    assert 0 < chance.sharpe_percentile < 100
    assert vd.monte_carlo(spark.createDataFrame(p.assign(sig=0.0)), runs=5).first().sharpe_percentile == 50.0


def test_search_finds_what_is_there(spark):
    rng = np.random.default_rng(12)
    n = 2400
    p = frame(n, 13)
    p["good"], p["also"], p["noise"] = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    p["ret"] = 0.004 * np.sign(p.good) * (np.abs(p.good) > 0.5) + 0.004 * np.sign(p.also) * (np.abs(p.also) > 0.5) + rng.normal(0, 0.006, n)
    df = spark.createDataFrame(p)
    one = {(r.indicator, r.direction) for r in rs.tester(df, ["good", "noise"]).where("is_sharpe >= 2 and verdict in ('CREDIBLE', 'SUSPICIOUS_OOS_BETTER')").collect()}
    assert one == {("good", 1)}
    found = rs.search(df, ["good", "also", "noise", "x"])
    top = found["pairs"].first()
    assert top.indicators == "also+good" and top.direction == 1
    both = {r.phase: r for r in found["summary"].collect()}
    assert both["singles"].credible >= 1 and both["singles"].tested == found["summary"].where("phase = 'singles'").first().tested
    # a pair by plain loops, thresholds of the look-back within the first part
    is_n = int(n * 0.6)
    a = p[:is_n]
    k = max(20, min(500, is_n // 3))
    side = {}
    for f in ("good", "also"):
        lo, hi = (a[f].rolling(k, min_periods=20).quantile(q) for q in (0.2, 0.8))
        side[f] = np.where(a[f] > hi, 1, np.where(a[f] < lo, -1, 0))
    agree = np.where((side["good"] == side["also"]) & (side["good"] != 0), side["good"], 0)
    r = (agree * a.ret - 0.0012)[agree != 0]
    row = rs.combinations(df, ["good", "also"], 2).where("config = 'pct_80' and direction = 1").first()
    daily = np.prod(1 + r) ** (1 / (is_n / 6)) - 1
    assert row.is_n == len(r) and row.is_win == pytest.approx((r > 0).mean())
    assert row.is_sharpe == pytest.approx(daily / (r.std(ddof=0) * math.sqrt(len(r) / (is_n / 6))) * math.sqrt(365))


def test_oos_search(spark):
    rng = np.random.default_rng(14)
    n = 2000
    p = frame(n, 15)
    p["good"] = rng.normal(size=n)
    p["ret"] = 0.01 * np.sign(p.good) * (np.abs(p.good) > 0.4) + rng.normal(0, 0.01, n)
    got = {(r.config, r.direction): r for r in vd.oos_search(spark.createDataFrame(p), ["good"]).collect()}
    cut = int(n * 0.7)
    th = np.percentile(p.good[:cut], 80)
    s = np.where(p.good > th, 1, np.where(p.good < -th, -1, 0))
    a = (s * p.ret)[:cut][greedy(s[:cut])]
    row = got["pct_80", 1]
    assert row.is_n == len(a) and row.is_sharpe == pytest.approx(a.mean() / a.std(ddof=1) * math.sqrt(min(len(a), 2190)))
    assert row.verdict in ("CREDIBLE", "MARGINAL") and ("pct_80", -1) not in got


def test_complete_strategy(spark):
    rng = np.random.default_rng(16)
    p = frame(1500, 17)
    p["good"] = rng.normal(size=1500)
    p["ret"] = np.where(p.good > 0.8, 0.01, rng.normal(0, 0.005, 1500))
    p["rsi_14"] = 100 * rng.random(1500)
    out = vd.complete_strategy(spark.createDataFrame(p), ["good", "x"])
    best = out["entries"].first()
    assert best.indicator == "good" and best.op == ">" and out["usage"].orderBy("indicator").first().indicator == "good"
    exits = {r.exit: r for r in out["exits"].collect()}
    assert {"overbought", "oversold"} <= set(exits) and any(k.startswith("exit_sl") for k in exits)
    assert 0 < exits["overbought"].hit_rate <= 1 and exits["overbought"].mean_bars < 8
    assert out["performance"].first().win_rate > 0.9


def test_shapiro_wilk(spark):
    """Published values to four digits; under normal values p is uniform, under others it is small; a series' draw is bounded."""
    import random

    from tidelake.functions.stats import normality, shapiro_wilk

    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.78881) < 1e-5 and abs(p - 0.006704) < 1e-6
    w, p = shapiro_wilk(range(1, 11))
    assert abs(w - 0.97016) < 1e-5 and abs(p - 0.8924) < 1e-4
    assert shapiro_wilk([1, 2])[0] != shapiro_wilk([1, 2])[0] and shapiro_wilk([3, 3, 3, 3]) == (1.0, 1.0) and abs(shapiro_wilk([1, 2, 3])[0] - 1) < 1e-12
    rng = random.Random(6)
    for n in (8, 40, 1000):
        found = sorted(shapiro_wilk([rng.gauss(3, 2) for _ in range(n)])[1] for _ in range(300))
        assert max(abs(x - (i + 0.5) / 300) for i, x in enumerate(found)) < 0.09
    assert shapiro_wilk([rng.expovariate(1) for _ in range(100)])[1] < 1e-4
    rows = [("a", i, rng.gauss(0, 1)) for i in range(3000)] + [("b", i, float(i % 3)) for i in range(50)] + [("b", 99, None), ("c", 1, 1.0)]
    got = {r.sym: r for r in normality(spark.createDataFrame(rows, "sym string, t long, r double").repartition(3), "r").collect()}
    assert got["a"].normal_p > 1e-3 and abs(got["b"].normal_w - shapiro_wilk([i % 3 for i in range(50)])[0]) < 1e-12 and got["c"].normal_p != got["c"].normal_p
