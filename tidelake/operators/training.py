"""A training run from features to a saved pipeline: selection, walk-forward, an ensemble, calibration, a report; and scoring with what was saved.

The stages are transformers of ``pyspark.ml`` with their state in params, so a
``PipelineModel`` writes and reads them on any file system that Spark reaches.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.quantiles import exact_quantiles
from tidelake.sources.store import checkpointed

from . import backtest as bt
from . import boosting
from . import learning as ln

SAVED = ("pipeline", "scores", "report")


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose whole state is params."""

    def _put(self, **values) -> _Stage:
        return self._set(**values)


class FillMissing(_Stage):
    """Missing and infinite values of columns become the training medians (zero for a column without one)."""

    columns = Param(Params._dummy(), "columns", "columns to fill", TypeConverters.toListString)
    medians = Param(Params._dummy(), "medians", "what to fill them with", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, columns=None, medians=None):
        super().__init__()
        self._put(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fill = dict(zip(self.getOrDefault(self.columns), self.getOrDefault(self.medians), strict=True))
        inside = lambda c: F.when(F.abs(F.nanvl(F.col(c).cast("double"), F.lit(float("inf")))) < float("inf"), F.col(c).cast("double"))
        return df.select(*[F.coalesce(inside(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in df.columns])


class BoosterScore(_Stage):
    """The probability of a booster, kept as text."""

    model = Param(Params._dummy(), "model", "the booster as JSON", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "column of the probability", TypeConverters.toString)

    @keyword_only
    def __init__(self, model=None, output=None):
        super().__init__()
        self._put(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return boosting.scored(boosting.Booster.from_json(self.getOrDefault(self.model)), df, self.getOrDefault(self.output))


class Blend(_Stage):
    """The weighted mean of columns."""

    columns = Param(Params._dummy(), "columns", "columns to blend", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "their weights", TypeConverters.toListFloat)
    output = Param(Params._dummy(), "output", "the mean's column", TypeConverters.toString)

    @keyword_only
    def __init__(self, columns=None, weights=None, output=None):
        super().__init__()
        self._put(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs = list(zip(self.getOrDefault(self.columns), self.getOrDefault(self.weights), strict=True))
        return df.withColumn(self.getOrDefault(self.output), sum((F.col(c) * w for c, w in pairs), F.lit(0.0)) / sum(w for _, w in pairs))


class Calibrate(_Stage):
    """A logistic curve from probabilities to calibrated ones."""

    slope = Param(Params._dummy(), "slope", "slope of the curve", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "its intercept", TypeConverters.toFloat)
    input = Param(Params._dummy(), "input", "column of probabilities", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "the calibrated column", TypeConverters.toString)

    @keyword_only
    def __init__(self, slope=None, intercept=None, input=None, output=None):
        super().__init__()
        self._put(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = F.col(self.getOrDefault(self.input)) * self.getOrDefault(self.slope) + self.getOrDefault(self.intercept)
        return df.withColumn(self.getOrDefault(self.output), 1 / (1 + F.exp(-x)))


def platt_curve(df: DataFrame, p: str = "p", y: str = "y", rounds: int = 50, l2: float = 1e-6) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton steps; each step is one aggregate of five sums."""
    df = checkpointed(df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(F.col(p).alias("p"), F.col(y).cast("double").alias("y")))
    a = b = 0.0
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.col("p") * a + b)))
        w, e = q * (1 - q), F.col("y") - q
        x = F.col("p")
        row = df.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in {"ga": e * x, "gb": e, "haa": w * x * x, "hab": w * x, "hbb": w}.items()]).first()
        h = np.array([[row.haa + l2, row.hab], [row.hab, row.hbb + l2]])
        step = np.linalg.solve(h, np.array([row.ga - l2 * a, row.gb - l2 * b]))
        step *= min(1.0, 10 / max(1e-12, float(np.abs(step).max())))
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-10:
            break
    return a, b


def figures(df: DataFrame, p: str = "calibrated", ret: str | None = None) -> dict[str, float]:
    """Accuracy, AUC, Brier score and log loss of probabilities, and of trades by them (long from .5 on, else short) the mean and the Sharpe ratio by bar."""
    q, y = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15)), F.col("y").cast("double")
    side = F.when(F.col(p) >= 0.5, 1).otherwise(-1)
    aggs = {"n": F.count("*"), "accuracy": F.avg(((F.col(p) >= 0.5).cast("double") == y).cast("double")), "brier": F.avg((F.col(p) - y) ** 2), "log_loss": F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))}
    if ret:
        aggs |= {"mean_return": F.avg(side * F.col(ret)), "sd": F.stddev_samp(side * F.col(ret))}
    row = df.agg(*[v.alias(k) for k, v in aggs.items()]).first().asDict()
    out = {k: float(v) if v is not None else math.nan for k, v in row.items() if k != "sd"}
    if ret:
        out["sharpe"] = out["mean_return"] / row["sd"] * math.sqrt(6 * 365) if row["sd"] else 0.0
    return out | {"auc": ln.auc(df, p) if out["n"] else math.nan}


def train(df: DataFrame, columns: list[str], ret: str | None = None, top: int = 50, purge: int = 6, train_rows: int = 300, test_rows: int = 50, rounds: int | None = None, **selection) -> tuple[PipelineModel, DataFrame, dict]:
    """A fitted pipeline, the scores of the selected columns, and a report.

    Columns are selected on the first 60 % of each series only. The ensemble
    learns from the first 60 % (``purge`` rows after each border are in no part),
    stops early and is weighted by the next 20 %, which the calibration curve
    is fitted on as well; the last 20 % are only measured. Walk-forward folds
    use the selected columns.
    """
    d = checkpointed(bt.split(df.where(F.col("y").isNotNull()).withColumn("y", F.col("y").cast("double")), purge=purge))
    part = lambda k: d.where(F.col("split") == k)
    chosen = ln.select(part("train"), columns, top=top, **selection)
    medians = exact_quantiles(part("train"), chosen, [0.5])
    fill = FillMissing(columns=chosen, medians=[float(medians[c][0] or 0.0) for c in chosen])
    filled = checkpointed(fill.transform(d.drop("p", "i", "cnt")))
    train_part, val, test = (filled.where(F.col("split") == k) for k in ("train", "val", "test"))
    both = train_part.unionByName(val).withColumn("_valid", F.col("split") == "val")
    models = ln.train(both, chosen, valid="_valid", rounds=rounds)
    weights = {n: ln.ensemble_weight(ln.auc(boosting.scored(m, val, "p"))) for n, m in models.items()}
    stages = [BoosterScore(model=m.to_json(), output=f"p_{n}") for n, m in models.items()]
    stages.append(Blend(columns=[f"p_{n}" for n in models], weights=list(weights.values()), output="p"))
    slope, intercept = platt_curve(PipelineModel(stages).transform(val))
    pipeline = PipelineModel([fill, *stages, Calibrate(slope=slope, intercept=intercept, input="p", output="calibrated")])
    folds = ln.walk_forward(filled.drop("split"), chosen, train_rows, test_rows, purge, names=tuple(models), rounds=rounds or 60).collect()  # one row for each fold
    by_split = {m: models[m].gains_by_column() for m in models}
    scores = df.sparkSession.createDataFrame([(i, c, *(float(by_split[m][c]) for m in models)) for i, c in enumerate(chosen)], "rank int, feature string, " + ", ".join(f"{m}_splits double" for m in models))
    aucs = [f.auc for f in folds]
    report = {
        "columns": chosen,
        "weights": weights,
        "trees": {n: len(m.trees) for n, m in models.items()},
        "calibration": [slope, intercept],
        "test": figures(pipeline.transform(part("test")), ret=ret),
        "folds": [{"fold": f.fold, "auc": f.auc} for f in folds],
        "walk_forward_auc": sum(aucs) / len(aucs) if aucs else None,
    }
    report["warnings"] = warnings(report)
    return pipeline, scores, report


def warnings(report: dict) -> list[str]:
    """What is too good to be true, or not good enough."""
    out, auc = [], report["walk_forward_auc"]
    if auc is None:
        out.append("no fold could be measured")
    elif auc > 0.70:
        out.append("AUC above 0.70: look for leakage")
    elif auc <= 0.55:
        out.append("AUC of 0.55 or less: may not pay its costs")
    if report["test"].get("sharpe", 0.0) > 5:
        out.append("Sharpe above 5: look at the calculation")
    return out


def save(spark: SparkSession, folder: str, pipeline: PipelineModel, scores: DataFrame, report: dict) -> None:
    """Everything of a run under one folder of a shared file system; an earlier run there is replaced."""
    pipeline.write().overwrite().save(f"{folder}/pipeline")
    scores.coalesce(1).write.mode("overwrite").parquet(f"{folder}/scores")
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")


def load(spark: SparkSession, folder: str) -> tuple[PipelineModel, DataFrame, dict]:
    """What ``save`` wrote."""
    report = json.loads(spark.read.text(f"{folder}/report").first().value)
    return PipelineModel.load(f"{folder}/pipeline"), spark.read.parquet(f"{folder}/scores"), report
