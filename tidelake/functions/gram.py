"""Correlations of hundreds of columns with pairwise nulls, from blocked sums of products.

Columns are centred by their means and nulls are zero, so that with X the
values and M the mask, X'X, X'M, (X*X)'M and M'M hold every pair's sums over
the rows that both columns have. Each task adds up these matrices for its rows
and sends them in blocks of rows of the matrix; a block's sums meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .package import send

#: Rows of the matrices that are sent and summed together.
BLOCK = 64


def _sums(width: int):
    def run(batches):
        total = np.zeros((4, width, width))
        for b in batches:
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(width)], axis=1)
            m = ~np.isnan(x)
            x, m = np.where(m, x, 0.0), m.astype(float)
            total += np.stack([x.T @ x, x.T @ m, (x * x).T @ m, m.T @ m])
        starts = range(0, width, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int32()), pa.array([total[:, i : i + BLOCK].tobytes() for i in starts], pa.binary())], ["start", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
    return pa.table({"start": table.column("start").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson correlations of every two columns over the rows in which both have a value; nan where that is undefined (no rows, a constant side).

    Infinite values count as missing. One pass for the means and one for the
    products; the result has a number for each pair of columns.
    """
    n = len(columns)
    if not n:
        return np.zeros((0, 0))
    send(df.sparkSession)
    finite = lambda c: F.when(F.abs(F.nanvl(F.col(c).cast("double"), F.lit(float("inf")))) < float("inf"), F.col(c).cast("double"))
    known = df.select(*[finite(c).alias(f"c{k}") for k, c in enumerate(columns)])
    means = known.agg(*[F.avg(f"c{k}").alias(f"c{k}") for k in range(n)]).first()
    centred = known.select(*[(F.col(f"c{k}") - F.lit(means[k] or 0.0)).alias(f"c{k}") for k in range(n)])
    parts = centred.mapInArrow(_sums(n), "start int, sums binary").groupBy("start").applyInArrow(_added, "start int, sums binary").collect()  # the matrices, once
    if not parts:
        return np.full((n, n), np.nan)
    xy, x, xx, m = np.concatenate([np.frombuffer(r.sums).reshape(4, -1, n) for r in sorted(parts, key=lambda r: r.start)], axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = m * xy - x * x.T
        a, b = m * xx - x * x, m * xx.T - x.T * x.T
        tiny = 1e-12 * m * np.maximum(xx, 1e-300)  # what is left of a constant after rounding
        rho = np.where((a > tiny) & (b > tiny.T), cov / np.sqrt(np.where(a > 0, a, np.nan) * np.where(b > 0, b, np.nan)), np.nan)
    return np.clip(rho, -1.0, 1.0)
