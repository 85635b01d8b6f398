"""Sequential operators over sorted series as streams of Arrow batches.

Rows are dealt by key and sorted within partitions; a step function sees the
values of one key chunk by chunk and carries its state along, so a series of
any length passes through in bounded memory, in linear time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .package import send


def scan(df: DataFrame, key: list[str], order: list[str], inputs: list[str], outputs: dict[str, str], step: Callable) -> DataFrame:
    """``df`` with new columns; ``step(state, *arrays) -> (state, [arrays])``, state None at a key's first rows."""
    send(df.sparkSession)
    kinds = {"double": (DoubleType(), pa.float64()), "long": (LongType(), pa.int64())}
    schema = StructType([*df.schema.fields, *(StructField(n, kinds[t][0]) for n, t in outputs.items())])
    names = df.columns

    def run(batches):
        last, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(names.index(k)) for k in key]
            cuts = [0, *_changes(at), b.num_rows]
            cols = [b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in inputs]
            made = [[] for _ in outputs]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if (here := tuple(c[i].as_py() for c in at)) != last:
                    last, state = here, None
                state, out = step(state, *(c[i:j] for c in cols))
                for m, o in zip(made, out, strict=True):
                    m.append(o)
            new = []
            for m, t in zip(made, outputs.values(), strict=True):
                v = np.concatenate(m)
                new.append(pa.array(v, kinds[t][1], from_pandas=True))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*names, *outputs])

    dealt = df.repartition(*key).sortWithinPartitions(*key, *order)
    return dealt.mapInArrow(run, schema)


def _changes(columns: list[pa.Array]) -> list[int]:
    """Places of rows whose key differs from that of the row before."""
    out = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out |= other.to_numpy(zero_copy_only=False)
    return (np.flatnonzero(out) + 1).tolist()


#: Rows that a recurrence takes in one matrix product.
CHUNK = 128


def recur(x: np.ndarray, keep: float, start: float) -> np.ndarray:
    """y[i] = keep * y[i - 1] + x[i], with ``start`` before the first row; blocks of rows by matrix products."""
    n = len(x)
    lag = np.subtract.outer(np.arange(CHUNK), np.arange(CHUNK))
    weights = np.where(lag >= 0, keep ** np.maximum(lag, 0).astype(float), 0.0)
    rows = np.zeros(-(-n // CHUNK) * CHUNK)
    rows[:n] = x
    out = rows.reshape(-1, CHUNK) @ weights.T
    carried = keep ** np.arange(1, CHUNK + 1)
    for block in out:
        block += start * carried
        start = block[-1]
    return out.ravel()[:n]


def ema_step(alpha: float, adjust: bool):
    """Exponential mean; NULL values keep the weight decaying, as with ignore_na=False."""

    def step(state, x):
        num, den, seen = state or (0.0, 0.0, False)
        out = np.full(len(x), np.nan)
        keep = 1 - alpha
        if not np.isnan(x).any():
            if adjust:
                a, b = recur(x, keep, num), recur(np.ones(len(x)), keep, den)
                return (a[-1], b[-1], True), [a / b]
            y = recur(alpha * x, keep, num / den if seen else x[0])
            return (y[-1], 1.0, True), [y]
        for i, v in enumerate(x.tolist()):
            if seen:
                num, den = num * keep, den * keep
            if v == v:
                w = 1.0 if adjust or not seen else alpha
                num, den, seen = num + w * v, den + w, True
                if not adjust:
                    num, den = num / den, 1.0
            if seen:
                out[i] = num / den
        return (num, den, seen), [out]

    return step


def ema(df: DataFrame, col: str, out: str, span: float | None = None, alpha: float | None = None, adjust: bool = True, key=("sym",), order=("ts",)) -> DataFrame:
    """Exponentially weighted mean of a column per key; linear in the rows."""
    return scan(df, list(key), list(order), [col], {out: "double"}, ema_step(alpha or 2 / (span + 1), adjust))


def greedy_step(holding: int):
    """0/1 of the signals that count: a signal counts if the last one that counted is ``holding`` rows away at least."""

    def step(state, s):
        at, free = state or (0, 0)
        keep = np.zeros(len(s), np.int64)
        for i in np.flatnonzero(np.nan_to_num(s) != 0).tolist():
            if at + i >= free:
                keep[i] = 1
                free = at + i + holding
        return (at + len(s), free), [keep]

    return step


def non_overlapping(df: DataFrame, signal: str, out: str, holding: int = 6, key=("sym",), order=("ts",)) -> DataFrame:
    """Greedy mask: a signal counts if the last one that counted is ``holding`` rows away at least."""
    return scan(df, list(key), list(order), [signal], {out: "long"}, greedy_step(holding))
