"""The training run: what is saved scores alike in another session; its parts by hand."""

import json
import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.functions.gram import correlation_matrix
from tidelake.operators import boosting
from tidelake.operators import learning as ln
from tidelake.operators import training as tr

COLS = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 420
    rows = []
    for sym in ("a", "b"):
        x = rng.normal(size=(n, 6))
        up = rng.random(n) < 1 / (1 + np.exp(-(1.6 * x[:, 0] - 1.2 * x[:, 1])))
        for i in range(n):
            v = [float(k) for k in x[i]]
            if i % 17 == 0:
                v[2] = None
            v[5] = v[0] * 2 + 1e-9 * v[3]  # a twin
            rows.append((sym, i, *v, float(up[i]), float(rng.normal() * 0.01 + (0.004 if up[i] else -0.004))))
    return spark.createDataFrame(rows, "sym string, t long, " + ", ".join(f"{c} double" for c in COLS) + ", y double, ret double").repartition(4).persist()


@pytest.fixture(scope="module")
def run(data):
    return tr.train(data, COLS, ret="ret", train_rows=250, test_rows=80, rounds=40)


def test_run(data, run):
    pipeline, scores, report = run
    assert "x5" not in report["columns"] or "x0" not in report["columns"]  # of twins one
    assert report["test"]["auc"] > 0.75 and report["test"]["accuracy"] > 0.65 and len(report["folds"]) == 3
    assert all(w == max(0.01, w) for w in report["weights"].values()) and 0 < report["trees"]["boosted_a"] <= 40
    assert any("leakage" in w for w in report["warnings"]) == (report["walk_forward_auc"] > 0.7)
    got = pipeline.transform(data.withColumn("x2", F.lit(None).cast("double"))).select("calibrated", "p").collect()
    assert len(got) == 840 and all(0 < r.calibrated < 1 for r in got)
    assert [r.feature for r in scores.orderBy("rank").collect()] == report["columns"]


def test_saved_pipeline_scores_alike_in_another_session(spark, data, run, tmp_path):
    pipeline, scores, report = run
    tr.save(spark, str(tmp_path / "model"), pipeline, scores, report)
    tr.save(spark, str(tmp_path / "model"), pipeline, scores, report)  # replaces
    back, table, said = tr.load(spark, str(tmp_path / "model"))
    assert said == json.loads(json.dumps(report)) and table.count() == scores.count()
    want = {(r.sym, r.t): r.calibrated for r in pipeline.transform(data).collect()}
    assert {(r.sym, r.t): r.calibrated for r in back.transform(data).collect()} == want
    data.drop("ret").write.parquet(str(tmp_path / "data"))
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from tidelake.operators.training import load
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
model, _, _ = load(s, {str(tmp_path / "model")!r})
model.transform(s.read.parquet({str(tmp_path / "data")!r})).select("sym", "t", "calibrated").write.json({str(tmp_path / "out")!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    got = {(r.sym, r.t): r.calibrated for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_calibration_curve_by_hand(spark):
    rows = [(0.1 * k, float(j < k)) for k in range(1, 10) for j in range(10)]
    a, b = tr.platt_curve(spark.createDataFrame(rows, "p double, y double"))
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    q = 1 / (1 + np.exp(-(a * x + b)))
    assert abs((y - q).sum()) < 1e-4 and abs(((y - q) * x).sum()) < 1e-4  # the likelihood's slope is zero
    assert all(math.isfinite(v) for v in tr.platt_curve(spark.createDataFrame([(0.2, 1.0), (0.9, 1.0)], "p double, y double")))


def test_ensemble_weights_and_a_fold_by_hand(data):
    d = data.where("sym = 'a'").withColumn("y", F.col("y"))
    cols = COLS[:3]
    a, b = d.where("t < 250"), d.where("t >= 250 and t < 330")
    models, weights = ln.ensemble(a, b, cols, rounds=60)
    for n, m in models.items():
        rows = boosting.scored(m, b).select("p", "y").collect()
        pos, neg = [r.p for r in rows if r.y == 1], [r.p for r in rows if r.y == 0]
        auc = np.mean([[(x > z) + (x == z) / 2 for z in neg] for x in pos])
        assert abs(weights[n] - max(0.01, (auc - 0.5) * 10)) < 1e-9
    p = {(r.sym, r.t): r for r in ln.probabilities(models, weights, b, cols).collect()}
    assert all(abs(r.p - sum(r[f"p_{n}"] * w for n, w in weights.items()) / sum(weights.values())) < 1e-12 for r in p.values())
    folds = {r.fold: r.auc for r in ln.walk_forward(d, cols, 250, 80, 6, rounds=10).collect()}
    model = ln.train(a, cols, ("boosted_a",), rounds=10)["boosted_a"]
    rows = boosting.scored(model, d.where("t >= 256 and t < 336")).select("p", "y").collect()
    pos, neg = [r.p for r in rows if r.y == 1], [r.p for r in rows if r.y == 0]
    assert abs(folds[0] - np.mean([[(x > z) + (x == z) / 2 for z in neg] for x in pos])) < 1e-9 and sorted(folds) == [0, 1, 2]


def test_importance_is_measured_on_held_out_rows(data):
    got = {r.feature: r for r in ln.importance(data, COLS).collect()}
    assert "x5" not in got and sorted(r.rank for r in got.values()) == [1, 2, 3, 4, 5]  # the later twin went
    assert {f for f, r in got.items() if r.rank <= 2} == {"x0", "x1"} and got["x0"].perm > 0.05 > abs(got["x4"].perm)
    assert ln.held_out(data).where("_test").groupBy("sym").agg(F.min("t").alias("a"), F.count("*").alias("n")).collect()[0][1:] == (420 - 52, 52)


def test_correlations_of_hundreds_of_columns(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 400)) + rng.normal(size=(300, 1)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8] = 5.0, np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(400)])).repartition(3)
    got, want = correlation_matrix(df, df.columns), pd.DataFrame(x).corr().to_numpy()
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)
    assert np.isnan(correlation_matrix(df.limit(0), df.columns[:3])).all() and correlation_matrix(df, []).shape == (0, 0)
