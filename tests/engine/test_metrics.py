"""Hand-computed figures of metrics and backtests."""

import math

import pytest
from pyspark.sql import functions as F

from tidelake.operators import backtest as bt
from tidelake.operators import metrics as m


def one(spark, rs, expr):
    return spark.createDataFrame([(float(r),) for r in rs], "r double").agg(expr.alias("x")).first().x


def test_returns_and_rates(spark):
    r = F.col("r")
    assert one(spark, [0.1, -0.1], F.product(1 + r) - 1) == pytest.approx(-0.01)
    assert one(spark, [0.01] * 7 + [-0.01] * 3 + [0.0] * 2, m.win_rate(r)) == pytest.approx(0.7)
    assert one(spark, [0.01] * 7 + [-0.01] * 3 + [0.0] * 2, m.win_rate(r, True)) == pytest.approx(7 / 12)
    assert one(spark, [0.1, -0.2, 0.05], m.profit_factor(r)) == pytest.approx(0.75)


def test_sharpe(spark):
    assert one(spark, [0.01] * 100, m.sharpe("h01_bar", F.col("r"))) == 0
    assert one(spark, [], m.sharpe("h01_bar", F.col("r"))) == 0
    mean, std, n = 0.001794, 0.004776, 37
    half = std * math.sqrt((n - 1) / (n - 1 + 0.0))
    rs = [mean + half * (1 if i % 2 else -1) for i in range(36)] + [mean]
    got = one(spark, rs, m.sharpe("h02_trade_frequency", F.col("r"), F.lit(60.0)))
    assert got == pytest.approx(5.64, abs=0.02)
    assert one(spark, [0.02, 0.01] * 20, m.sharpe("h11_walk_forward", F.col("r"))) == 5


def test_drawdown(spark):
    df = spark.createDataFrame([("a", i, r) for i, r in enumerate([0.1, -0.2, 0.05])], "sym string, t long, r double")
    assert m.equity(df).agg(F.min("drawdown")).first()[0] == pytest.approx(-0.2)
    lost = spark.createDataFrame([("a", 0, -0.5), ("a", 1, 0.1)], "sym string, t long, r double")
    assert m.equity(lost, start_at_one=False).agg(F.min("drawdown")).first()[0] == 0
    assert m.equity(lost).agg(F.min("drawdown")).first()[0] == pytest.approx(-0.5)


def test_backtest_counts(spark):
    sig = [1 if 10 <= i < 20 or 50 <= i < 60 else -1 if 30 <= i < 40 or 70 <= i < 80 else 0 for i in range(100)]
    df = spark.createDataFrame([("a", i, s, 0.01) for i, s in enumerate(sig)], "sym string, t long, sig int, ret double")
    out = bt.costed(df, cost=0.001)
    row = out.agg(F.count_if(F.col("pos") > 0).alias("long"), F.count_if(F.col("pos") < 0).alias("short"), F.sum("gross").alias("g"), F.sum("r").alias("n")).first()
    assert (row.long, row.short) == (20, 20) and row.g == pytest.approx(0) and row.n == pytest.approx(-0.008)


def test_grade(spark):
    row = spark.range(1).select(m.grade(F.lit(2.1), F.lit(0.6), F.lit(-0.05), F.lit(True), F.lit(0.01), F.lit(1.0)).alias("a"), m.grade(F.lit(11.0), F.lit(0.6), F.lit(-0.05), F.lit(True), F.lit(0.01), F.lit(1.0)).alias("f"), m.kelly(F.lit(0.7)).alias("k")).first()
    assert (row.a, row.f) == ("A", "F") and row.k == 0.25
