"""Closed-form distributions: normal, Student t, chi-square with one degree, binomial; for single values and for columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .package import send


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def binomial_sf(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else beta_inc(k, n - k + 1, p) if k <= n else 0.0


def chi2_1_sf(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0) / 2))


def _column(f, *cols) -> Column:
    """A function of aggregated figures as a column; used on one row per rule, never on the data."""

    send()

    @F.pandas_udf("double")
    def run(*xs: pd.Series) -> pd.Series:
        return pd.Series([f(*v) if all(x == x and x is not None for x in v) else None for v in zip(*xs, strict=True)], dtype="float64")

    return run(*cols)


def t_pvalue(t: Column, n: Column) -> Column:
    """Two-sided p of a mean's t statistic over n values."""
    return _column(lambda t, n: 2 * t_sf(abs(t), n - 1) if n > 1 else float("nan"), t.cast("double"), n.cast("double"))


def binomial_pvalue(k: Column, n: Column, p: float = 0.5) -> Column:
    return _column(lambda k, n: binomial_sf(int(k), int(n), p), k.cast("double"), n.cast("double"))


def normal_pvalue(z: Column) -> Column:
    """Two-sided p of a standard normal value."""
    return _column(lambda z: 2 * normal_sf(abs(z)), z.cast("double"))


def ljung_box_1(r1: Column, n: Column) -> Column:
    """p of the Ljung-Box statistic at lag 1."""
    q = n * (n + 2) * r1 * r1 / (n - 1)
    return _column(chi2_1_sf, q.cast("double"))


def jarque_bera(skew: Column, kurt: Column, n: Column) -> Column:
    """p of normality from the moments."""
    return F.exp(-(n / 6 * (skew * skew + kurt * kurt / 4)) / 2)


# Coefficients of the approximations of the Shapiro-Wilk test (weights of the two largest order
# statistics; mean and log deviation of the transformed statistic, for 4 to 11 values and for more).
_LARGEST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_FEW_GAMMA = (-2.273, 0.459)
_FEW_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
_FEW_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_MANY_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_MANY_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients, x: float) -> float:
    return sum(c * x**k for k, c in enumerate(coefficients))


def normal_order_weights(n: int) -> np.ndarray:
    """Weights of sorted values in the Shapiro-Wilk statistic, from expected normal order statistics; they sum to zero, their squares to one."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    inv = NormalDist().inv_cdf
    m = np.array([inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(total)
    last = a[-1] + _poly(_LARGEST, u)
    if n > 5:
        second = a[-2] + _poly(_SECOND, u)
        rest = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / math.sqrt(rest)
        a[-2], a[1] = second, -second
    else:
        a = m / math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[-1], a[0] = last, -last
    return a


def shapiro_wilk(values) -> tuple[float, float]:
    """The statistic and its p for 3 to 5,000 values; (1, 1) where all are equal, nan for fewer than three."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3:
        return float("nan"), float("nan")
    spread = x - x.mean()
    if x[-1] - x[0] < 1e-300 or not (spread @ spread):
        return 1.0, 1.0
    a = normal_order_weights(n)
    w = min(1.0, float(a @ x) ** 2 / float(spread @ spread))
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    y, log_n = math.log(max(1 - w, 1e-19)), math.log(n)
    if n <= 11:
        gamma = _poly(_FEW_GAMMA, n)
        if y >= gamma:
            return w, 1e-99
        y, mean, sd = -math.log(gamma - y), _poly(_FEW_MEAN, n), math.exp(_poly(_FEW_LOG_SD, n))
    else:
        mean, sd = _poly(_MANY_MEAN, log_n), math.exp(_poly(_MANY_LOG_SD, log_n))
    return w, normal_sf((y - mean) / sd)


#: Values of a series that normality is tested on, at most.
NORMALITY_SAMPLE = 1000


def normality(df: DataFrame, r: str, key: str = "sym", order: str = "t", seed: int = 42, most: int = NORMALITY_SAMPLE) -> DataFrame:
    """``key``, normal_w, normal_p: the Shapiro-Wilk test on up to ``most`` non-null values of each series, drawn by a hash of ``order``.

    A series' draw is what a window keeps of it, so a task holds ``most`` values of a series at once.
    """
    send(df.sparkSession)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(order, F.lit(seed)), order))
    drawn = df.where(F.col(r).isNotNull()).select(F.col(key), F.col(r).cast("double").alias("x"), place.alias("place")).where(F.col("place") <= most)
    values = drawn.groupBy(key).agg(F.collect_list("x").alias("x"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [shapiro_wilk(x) for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))], [key, "normal_w", "normal_p"])

    return values.mapInArrow(run, f"{key} {kind}, normal_w double, normal_p double")
