"""Series in stretches against the single pass: same rows wherever the stretches are cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelake.functions.carry import Before, Ema, Greedy, Running, carried
from tidelake.functions.scan import ema_step, greedy_step, scan

CARRIES = [Ema(0.2, True), Ema(0.1, False), Running("sum"), Running("product"), Running("max"), Greedy(6), Before()]
INPUTS = ["x", "x", "x", "p", "x", "s", "x"]
OUT = {"a": "double", "b": "double", "c": "double", "d": "double", "e": "double", "g": "long", "v": "double"}


def single(df):
    steps = [ema_step(0.2, True), ema_step(0.1, False), *(c.step for c in CARRIES[2:5]), greedy_step(6), CARRIES[6].step]

    def step(states, *values):
        states, out = states or [None] * 7, []
        for k, (f, v) in enumerate(zip(steps, values, strict=True)):
            states[k], (o,) = f(states[k], v)
            out.append(o)
        return states, out

    return scan(df, ["sym"], ["t"], INPUTS, OUT, step)


def frame(spark, sizes, gaps=True, seed=3):
    rng = np.random.default_rng(seed)
    parts = []
    for sym, n in sizes.items():
        x = rng.normal(size=n) * 3
        if gaps and n:
            x[rng.random(n) < 0.3] = np.nan
            x[: n // 5] = np.nan  # nothing known at first
        parts.append(pd.DataFrame({"sym": sym, "t": np.arange(n), "x": x, "p": 1 + x / 1e3, "s": (rng.random(n) < 0.3).astype(float)}))
    df = spark.createDataFrame(pd.concat(parts))
    return df.select("sym", "t", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "p", "s")])


def same(a, b):
    a, b = (d.orderBy("sym", "t").toPandas() for d in (a, b))
    assert len(a) == len(b) and (a[["sym", "t"]] == b[["sym", "t"]]).all().all()
    for c in OUT:
        assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), c


@pytest.mark.parametrize("stretches", [1, 7, 40])
def test_like_the_single_pass(spark, stretches):
    df = frame(spark, {"a": 500, "b": 3, "c": 211, "d": 1, "e": 90})
    same(carried(df, ["sym"], ["t"], INPUTS, OUT, CARRIES, stretches), single(df))


def test_one_long_series_uses_all_tasks(spark):
    df = frame(spark, {"a": 60_000}, gaps=False)
    got = carried(df, ["sym"], ["t"], INPUTS, OUT, CARRIES, 8)
    same(got, single(df))
    rows = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(rows) == 8 and max(rows) < 2 * 60_000 / 8


def test_nothing(spark):
    df = frame(spark, {"a": 4})
    assert carried(df.limit(0), ["sym"], ["t"], INPUTS, OUT, CARRIES, 3).count() == 0
    nothing = df.withColumn("x", F.lit(None).cast("double"))
    same(carried(nothing, ["sym"], ["t"], INPUTS, OUT, CARRIES, 3), single(nothing))
