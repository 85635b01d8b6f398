"""Every query that has SQL gives the rows of its SQL; the others run."""

import glob
import math
import os

import duckdb
import pytest

from tidelake import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def value(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return float(v) if not isinstance(v, (bool, str)) else v


def order(r):
    return [("" if x is None else f"{x:022.4f}" if isinstance(x, float) else str(x)) for x in r]


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    out = con.execute(SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == cols
    got = sorted(([value(r[c]) for c in cols] for r in df.collect()), key=order)
    want = sorted(([value(r[names.index(c)]) for c in cols] for r in out.fetchall()), key=order)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


#: What queries without SQL have to show: columns, and a check of their rows.
SHAPES = {
    "l01_importance": (["corr", "feature", "mi", "perm", "rank", "score", "shap"], lambda r: sorted(x["rank"] for x in r) == list(range(1, len(r) + 1)) and len(r) >= 4 and all(0 <= x["score"] <= 1 and x["shap"] > 0 for x in r)),
    "l01_attributions": (["attribution", "feature", "margin", "sym", "t", "total"], lambda r: len(r) > 100 and all(abs(x["total"] - x["margin"]) < 1e-9 for x in r)),
    "l04_pillars": (["actual", "assumed", "deviation", "outside", "pillar", "recommendation"], lambda r: len(r) == 4 and all(abs(x["actual"] - x["assumed"] - x["deviation"]) < 1e-9 for x in r) and abs(sum(x["actual"] for x in r) + r[0]["outside"] - 1) < 1e-9),
    "l11_train": (["calibrated", "folds", "p", "sym", "t", "test_auc"], lambda r: len(r) > 500 and all(0 <= x["calibrated"] <= 1 for x in r) and r[0]["folds"] >= 2 and 0.5 < r[0]["test_auc"] < 1),
    "l11_scores": (["boosted_a_splits", "boosted_b_splits", "feature", "rank"], lambda r: sorted(x["rank"] for x in r) == list(range(len(r))) and sum(x["boosted_a_splits"] for x in r) > 0),
    "l12_evolved_thresholds": (["baseline", "score", "threshold", "value"], lambda r: len(r) == 12 and all(x["score"] >= x["baseline"] for x in r)),
    "l03_category_importance": (["category", "share", "w"], lambda r: abs(sum(x["share"] for x in r) - 1) < 1e-9 and {x["category"] for x in r} == {"price", "flow"}),
    "l05_selected": (["feature", "rank"], lambda r: 1 <= len(r) <= 4 and "price_return_1h" not in {x["feature"] for x in r}),
    "l07_ensemble": (["p", "sym", "t"], lambda r: len(r) > 50 and all(0 <= x["p"] <= 1 for x in r)),
    "l08_anchored": (["p", "sig", "sym", "t"], lambda r: all(x["sig"] == (1 if x["p"] > 0.55 else -1 if x["p"] < 0.45 else 0) for x in r)),
    "l09_platt": (["calibrated", "p", "sym", "t"], lambda r: all(0 <= x["calibrated"] <= 1 for x in r) and len({x["calibrated"] for x in r}) > 10),
    "l10_walk_forward": (["auc", "fold"], lambda r: [x["fold"] for x in sorted(r, key=lambda x: x["fold"])] == list(range(len(r))) and len(r) >= 2 and all(0 <= x["auc"] <= 1 for x in r)),
    "l12_optimised_weights": (["baseline", "pillar", "score", "weight"], lambda r: abs(sum(x["weight"] for x in r) - 1) < 1e-9 and all(x["score"] >= x["baseline"] for x in r)),
    "l12_optimised_thresholds": (["baseline", "score", "threshold", "value"], lambda r: len(r) == 12 and all(x["score"] >= x["baseline"] for x in r)),
    "l14_feature_clusters": (["cluster", "feature", "k"], lambda r: len(r) == 6 and len({x["cluster"] for x in r}) == r[0]["k"]),
    "l14_structures": (["rank", "score", "structure"], lambda r: {"4 pillars", "3 pillars", "5 pillars", "2 pillars", "flat"} <= {x["structure"] for x in r} and [x["score"] for x in sorted(r, key=lambda x: x["rank"])] == sorted((x["score"] for x in r), reverse=True)),
    "l15_full_optimisation": (["baseline", "score", "what"], lambda r: all(x["score"] >= x["baseline"] for x in r)),
    "m16_validate": (None, lambda r: len(r) == 5 and all(x["grade"] in "ABCDF" for x in r)),
    "r11_tree_rules": (["conditions", "confidence", "direction", "rule", "support"], lambda r: len(r) > 1 and all(x["support"] >= 20 and 0.5 <= x["confidence"] <= 1 for x in r)),
    "r12_genetic_rules": (["rank", "rule", "sharpe"], lambda r: [x["sharpe"] for x in sorted(r, key=lambda x: x["rank"])] == sorted((x["sharpe"] for x in r), reverse=True)),
    "r18_complete_strategy": (["exit", "hit_rate", "mean_bars", "mean_return", "n", "sym"], lambda r: all(0 <= x["hit_rate"] <= 1 and x["mean_bars"] <= 24 for x in r)),
    "r19_loss_clusters": (["confidence", "frequency", "impact", "loss_rate", "losses", "mean_loss", "n", "pattern", "sym"], lambda r: all(x["n"] >= 20 and x["loss_rate"] >= 0.55 for x in r)),
    "r24_search_summary": (["by_chance", "credible", "insufficient", "passed_is", "phase", "survival", "tested"], lambda r: all(x["tested"] >= x["passed_is"] >= x["insufficient"] for x in r) and "singles" in {x["phase"] for x in r}),
    "r27_critic": (None, lambda r: {x["verdict"] for x in r} <= {"CREDIBLE", "SUSPICIOUS", "DEBUNKED"} and len(r) == 25),
    "s08_equity_png": (["png", "sym"], lambda r: len({x["sym"] for x in r}) == len(r) == 3 and all(bytes(x["png"][:8]) == b"\x89PNG\r\n\x1a\n" for x in r)),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    columns, check = SHAPES[name]
    df = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    assert columns is None or sorted(df.columns) == columns
    assert rows and check(rows)


def test_synthetic_market_is_the_same_however_it_is_dealt(spark):
    from tidelake.sources.synthetic import market

    a = sorted(map(tuple, market(spark, 50, 2).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = sorted(map(tuple, market(spark.newSession(), 50, 2).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def test_synthetic_patterns(spark):
    from pyspark.sql import functions as F
    from tidelake.functions.windows import Series
    from tidelake.sources.synthetic import market

    s = Series("sym", "t")

    def after(patterns):
        df = market(spark, 4000, 1, patterns=patterns).withColumn("push", F.col("close") / s.lag("close") - 1)
        df = df.withColumn("before", s.lag("fear_greed_index"))
        return df.agg(F.avg(F.when(F.col("before") > 80, F.col("close"))).alias("hot"), F.avg(F.when(F.col("before") < 20, F.col("close"))).alias("cold"), F.count_if(F.col("before") > 80).alias("n"), F.count_if(F.col("before") < 20).alias("k")).first()

    a, b = after(True), after(False)
    assert (a.n, a.k) == (b.n, b.k) and a.n > 2 and a.k > 10
    assert a.hot < b.hot and a.cold > b.cold


def test_best_of_given_choices(spark):
    """Searches find what was put in."""
    import numpy as np
    import pandas as pd
    from tidelake.operators import learning as ln
    from tidelake.operators import structure as sr

    rng = np.random.default_rng(3)
    n = 1500
    p = pd.DataFrame({"sym": "a", "t": np.arange(n) * 14400, "funding_a": rng.normal(size=n), "rsi_a": rng.normal(size=n), "liq_a": rng.normal(size=n), "vix_a": rng.normal(size=n)})
    p["ret"] = 0.01 * np.sign(p.liq_a) + rng.normal(0, 0.01, n)
    df = spark.createDataFrame(p)
    cols = ["funding_a", "rsi_a", "liq_a", "vix_a"]
    w = sr.best_weights(df, cols, {"d": ["funding_a"], "l": ["liq_a"]}, {"d": 0.9, "l": 0.1}, tries=20)
    assert w["weights"]["l"] > 0.6 and w["score"] > w["baseline"]
    ranking = sr.structures(df, cols)
    assert len(ranking) >= 5 and dict((x[0], x[3]) for x in ranking)["3 pillars"] > 0.3 and ranking[0][3] == max(x[3] for x in ranking)
    found = ln.genetic(df, cols, size=20, rounds=5, min_trades=30)
    assert found and any(c.feature == "liq_a" and c.operator == ">" for c in found[0][0].conditions)
    assert sr.alternatives({"liquidity": 0.01, "macro": 0.2}) == ["3 pillars", "5 pillars", "flat"] and sr.alternatives({"liquidity": 0.1}) == ["flat"]
    p["ret"] = np.where(p.vix_a > 1, -0.01, rng.normal(0.002, 0.01, n))
    leaves = ln.loss_rules(spark.createDataFrame(p), cols)
    assert any(c.feature == "vix_a" and c.operator == ">" for r in leaves for c in r.conditions)


def test_zero_prices_are_no_values_under_either_key(spark, tmp_path):
    from tidelake.sources import feeds

    texts = ['{"open":0.0}', '{"o":0.0}', '{"o":0,"open":0}', '{"o":"0.00"}', '{"o":-0.0}', '{"open":0e0,"o":7.5}', '{"open":3,"o":0}', '{"open":null,"o":"2.25"}', "{}", "no JSON", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, p string")
    got = {r.i: r.x_open for r in feeds.ohlc_payload(df, "p", "x").collect()}
    assert [got[i] for i in range(len(texts))] == [None, None, None, None, None, 7.5, 3.0, 2.25, None, None, None]

    # bars of four hours under long and short keys in turn, with each price zero in some
    hours = "interval (4 * (i // 3)) hours + interval (i) minutes"
    duckdb.execute(f"copy (select i as event_id, timestamp '2024-01-01' + {hours} as ts, 'a' as event_type, case when i % 7 in (0, 1) or i // 3 in (4, 5) then 0.0 else i / 4 end as value from range(60) r(i)) to '{tmp_path}/events.parquet'")
    name = "s14_ohlc_payload"
    want = duckdb.sql(SQL[name].replace("from events", f"from '{tmp_path}/events.parquet'")).fetchall()
    assert {r[1] // 14400 % 2 for r in want if None in r} == {0, 1} and any(None not in r for r in want)
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)


def test_limiter_and_retries(monkeypatch):
    from tidelake.sources import feeds

    now, slept = [0.0], []
    monkeypatch.setattr(feeds.time, "monotonic", lambda: now[0])
    monkeypatch.setattr(feeds.time, "sleep", lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    x = feeds.RateLimiter(2.0)
    for _ in range(4):
        x.wait()
    assert abs(sum(slept) - 1.5) < 1e-9 and feeds.limiter(3.0) is feeds.limiter(3.0)
    calls, slept[:] = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no answer")
        return 7

    assert feeds.with_retries(fails) == 7 and slept == [1.0, 2.0]
    with pytest.raises(OSError):
        feeds.with_retries(lambda: (_ for _ in ()).throw(OSError()), tries=2)


def test_learning_finds_the_signal(spark):
    from pyspark.sql import functions as F

    from tidelake.operators import learning as ln

    df = spark.range(400).select(F.lit("a").alias("sym"), F.col("id").alias("t"), F.randn(1).alias("good"), F.randn(2).alias("noise"), F.randn(3).alias("twin"))
    df = df.withColumn("twin", F.col("good") + 0.01 * F.col("twin")).withColumn("y", (F.col("good") + 0.3 * F.col("noise") > 0).cast("double")).cache()
    assert ln.select(df, ["good", "noise", "twin"], top=1) == ["good"]
    assert ln.without_twins(df, ["good", "noise", "twin"]) == ["good", "noise"]
    models = ln.train(df, ["good", "noise"], ("linear",))
    assert ln.auc(ln.probabilities(models, {"linear": 1.0}, df, ["good", "noise"])) > 0.9
    assert any(c.feature == "good" for r in ln.tree_rules(df, ["good", "noise"]) for c in r.conditions)


def test_folds_reach_the_end(spark):
    from pyspark.sql import functions as F
    from tidelake.operators import backtest as bt
    from tidelake.operators import learning as ln

    rows = [("a", t, float(t * 7 % 5), float(t * 7 % 5 > 2)) for t in range(1700)] + [("b", t, 0.0, 0.0) for t in range(80)]
    x = spark.createDataFrame(rows, "sym string, t long, x double, y double")
    tested = bt.folds(x, 60, 30).where("part = 'test'").groupBy("sym").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).collect()
    assert {(r.sym, r.a, r.b, r.n) for r in tested} == {("a", 72, 1699, 1628), ("b", 72, 79, 8)}
    assert [r.fold for r in ln.walk_forward(x.where("sym = 'a' and t < 200"), ["x"], 60, 40).orderBy("fold").collect()] == [0, 1, 2, 3]
