"""Exact quantiles of whole columns, and of growing windows, without one task that merges or re-reads everything."""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import scan

#: Ranks that the first pass tells apart; it brackets a quantile by a few of them.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """Linear quantiles of columns over all rows (nulls left out); None for a column without values.

    The first pass brackets each quantile by approximate ranks; the second
    counts what lies below the bracket and the values inside it, a few in ten
    thousand of all and ties, from which the exact ones are picked. Columns of up
    to ACCURACY values are sorted whole instead.
    """
    if not columns:
        return {}
    wide = 2 / ACCURACY
    ends = [x for q in qs for x in (max(0.0, q - wide), min(1.0, q + wide))]
    first = df.agg(*[F.percentile_approx(F.col(c).cast("double"), ends, ACCURACY).alias(f"a{i}") for i, c in enumerate(columns)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    brackets = [(i, j, first[f"a{i}"][2 * j], first[f"a{i}"][2 * j + 1]) for i in range(len(columns)) if first[f"n{i}"] > ACCURACY for j in range(len(qs))]
    out: dict[str, list[float | None]] = {c: [None] * len(qs) for c in columns}
    small = [c for i, c in enumerate(columns) if 0 < first[f"n{i}"] <= ACCURACY]
    if small:
        row = df.agg(*[F.percentile(F.col(c).cast("double"), qs).alias(f"p{i}") for i, c in enumerate(small)]).first()
        out |= {c: list(row[f"p{i}"]) for i, c in enumerate(small)}
    if not brackets:
        return out
    value = lambda i: F.col(columns[i]).cast("double")
    below = df.agg(*[F.count_if(value(i) < lo).alias(f"b{k}") for k, (i, _, lo, _) in enumerate(brackets)]).first()
    inside = F.array_compact(F.array(*[F.when(value(i).between(lo, hi), F.struct(F.lit(k).alias("k"), value(i).alias("v"))) for k, (i, _, lo, hi) in enumerate(brackets)]))
    counts = df.select(F.inline(inside)).groupBy("k", "v").agg(F.count("*").alias("n"))
    so_far = counts.select("k", "v", F.sum("n").over(Window.partitionBy("k").orderBy("v")).alias("upto"), "n")
    place = {k: qs[j] * (first[f"n{i}"] - 1) for k, (i, j, _, _) in enumerate(brackets)}
    wanted = F.lit(False)
    for k, at in place.items():
        for x in sorted({math.floor(at), math.ceil(at)}):
            rank = x - below[f"b{k}"]
            wanted = wanted | ((F.col("k") == k) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    found: dict[int, list] = {}
    for r in so_far.where(wanted).collect():  # two values of each quantile at most
        found.setdefault(r.k, []).append((r.upto - r.n, r.upto, r.v))
    for k, (i, j, _, _) in enumerate(brackets):
        at = place[k]

        def ranked(x: int, k: int = k) -> float:
            return next(v for a, b, v in found[k] if a <= x - below[f"b{k}"] < b)

        low, high = ranked(math.floor(at)), ranked(math.ceil(at))
        out[columns[i]][j] = low + (high - low) * (at - math.floor(at))
    return out


class Ordered:
    """Values in order in blocks of bounded size: insertion and the k-th value without moving all."""

    SIZE = 1024

    def __init__(self):
        self.blocks: list[list[float]] = []
        self.n = 0

    def add(self, x: float) -> None:
        self.n += 1
        if not self.blocks:
            self.blocks.append([x])
            return
        at = min(bisect.bisect_left(self.blocks, x, key=lambda b: b[-1]), len(self.blocks) - 1)
        block = self.blocks[at]
        bisect.insort(block, x)
        if len(block) > self.SIZE:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]

    def kth(self, k: int) -> float:
        for b in self.blocks:
            if k < len(b):
                return b[k]
            k -= len(b)
        raise IndexError(k)

    def quantile(self, q: float) -> float:
        at = q * (self.n - 1)
        part = at - math.floor(at)
        return self.kth(math.floor(at)) * (1 - part) + self.kth(math.ceil(at)) * part


def expanding_quantile(df: DataFrame, col: str, out: str, q: float, least: int = 1, key=("sym",), order=("t",)) -> DataFrame:
    """The quantile of all values of a series so far, NULL below ``least`` of them; one sorted pass."""

    def step(state, x):
        seen = state or Ordered()
        y = np.full(len(x), np.nan)
        for i, v in enumerate(x.tolist()):
            if v == v:
                seen.add(v)
            if seen.n >= least:
                y[i] = seen.quantile(q)
        return seen, [y]

    return scan(df, list(key), list(order), [col], {out: "double"}, step)
