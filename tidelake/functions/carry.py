"""Sequential operators over one long series in many tasks.

Rows are dealt by ranges of (key, order) and written, so a task holds a stretch
of time. Each stretch yields a small summary of what it does to the state
that reaches it; summaries of consecutive stretches compose, so one pass over
them, one row a stretch, gives the state before each stretch, and all stretches
are finished side by side. ``scan`` does the same in one task a series; the two
agree (the sums to rounding).
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidelake.sources.store import checkpointed

from .package import send
from .scan import _changes, ema_step, greedy_step


class Ema:
    """Exponential mean, as ``scan.ema_step``."""

    def __init__(self, alpha: float, adjust: bool):
        self.alpha, self.adjust = alpha, adjust
        self.step = ema_step(alpha, adjust)

    def fold(self, summary, x):
        """Of adjusted means: rows, and the sums that start from nothing. Of others: rows before the first value, that
        value, and the states that follow it from a mean of zero and of one, which tell what becomes of any mean."""
        if self.adjust:
            n, state = summary or (0, None)
            return n + len(x), self.step(state, x)[0]
        lead, first, zero, one = summary or (0, None, None, None)
        if first is None:
            some = np.flatnonzero(~np.isnan(x))
            if not len(some):
                return lead + len(x), None, None, None
            lead, first, x = lead + int(some[0]), float(x[some[0]]), x[some[0] + 1 :]
            zero, one = (0.0, 1.0, True), (1.0, 1.0, True)
        if len(x):
            zero, one = self.step(zero, x)[0], self.step(one, x)[0]
        return lead, first, zero, one

    def through(self, state, summary):
        num, den, seen = state or (0.0, 0.0, False)
        keep = 1 - self.alpha
        if self.adjust:
            n, own = summary
            if not seen:
                return own
            return num * keep**n + own[0], den * keep**n + own[1], True
        lead, first, zero, one = summary
        if first is None:
            return (num * keep**lead, den * keep**lead, seen) if seen else (num, den, seen)
        y = first
        if seen:
            weight = den * keep ** (lead + 1)
            y = (num * keep ** (lead + 1) + self.alpha * first) / (weight + self.alpha)
        return zero[0] + (one[0] - zero[0]) * y, zero[1], True


class Running:
    """Running sum, product or maximum; missing values are passed over and unknown until the first value."""

    def __init__(self, kind: str):
        self.op, self.start = {"sum": (np.add, 0.0), "product": (np.multiply, 1.0), "max": (np.maximum, -np.inf)}[kind]

    def fold(self, summary, x):
        total, seen = summary or (self.start, False)
        known = x[~np.isnan(x)]
        return (float(self.op(total, self.op.reduce(known))), True) if len(known) else (total, seen)

    def through(self, state, summary):
        total, seen = state or (self.start, False)
        return float(self.op(total, summary[0])), seen or summary[1]

    def step(self, state, x):
        total, seen = state or (self.start, False)
        known = ~np.isnan(x)
        out = self.op.accumulate(np.concatenate([[total], np.where(known, x, self.start)]))[1:]
        since = np.logical_or.accumulate(known) | seen
        return (float(out[-1]), bool(since[-1])), [np.where(since, out, np.nan)]


class Before:
    """The value of the row before."""

    def fold(self, summary, x):
        return float(x[-1]) if len(x) else summary

    def through(self, state, summary):
        return summary

    def step(self, state, x):
        return float(x[-1]), [np.concatenate([[np.nan if state is None else state], x[:-1]])]


class Greedy:
    """Signals that are ``holding`` rows apart, taken greedily: a stretch maps rows still blocked at its begin to rows blocked at its end."""

    def __init__(self, holding: int):
        self.holding, self.step = holding, greedy_step(holding)

    def fold(self, summary, s):
        states = summary or [(0, blocked) for blocked in range(max(1, self.holding))]
        return [self.step(state, s)[0] for state in states]

    def through(self, state, summary):
        at, free = state or (0, 0)
        end, ends_free = summary[min(max(0, free - at), len(summary) - 1)]
        return at + end, at + ends_free


def carried(df: DataFrame, key: list[str], order: list[str], inputs: list[str], outputs: dict[str, str], carries: list, stretches: int | None = None) -> DataFrame:
    """``df`` with new columns: one for each carry, whose step reads the input of its place.

    ``stretches``: tasks to deal the rows to, by default as many as shuffles
    have. The driver holds a summary for each of them, whatever the number of
    keys: only the last key of a stretch goes on in the next one.
    """
    spark = df.sparkSession
    send(spark)
    names, n = df.columns, stretches or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {"double": (DoubleType(), pa.float64()), "long": (LongType(), pa.int64())}
    dealt = checkpointed(df.repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order))

    def runs(batches):
        """Parts of batches with one key each: key, the batch's place of begin and end, values."""
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(names.index(k)) for k in key]
            cols = [b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in inputs]
            cuts = [0, *_changes(at), b.num_rows]
            yield b, [(tuple(c[i].as_py() for c in at), [c[i:j] for c in cols]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def summed(batches):
        first, last, summaries = None, None, None
        for _, parts in runs(batches):
            for k, values in parts:
                if first is None:
                    first = k
                if k != last:
                    last, summaries = k, [None] * len(carries)
                summaries = [c.fold(s, v) for c, s, v in zip(carries, summaries, values, strict=True)]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps((first, last, summaries))])], ["part", "summary"])

    before, state, going = {}, None, None
    for r in sorted(dealt.mapInArrow(summed, "part long, summary binary").collect(), key=lambda r: r.part):  # one row for each stretch
        first, last, summaries = pickle.loads(bytes(r.summary))
        if first == going:
            before[r.part] = state
        if last != going or state is None:
            state = [None] * len(carries)
        state, going = [c.through(s, x) for c, s, x in zip(carries, state, summaries, strict=True)], last

    def finished(batches):
        states = before.get(TaskContext.get().partitionId()) or [None] * len(carries)
        last = None
        for b, parts in runs(batches):
            made: list[list[np.ndarray]] = [[] for _ in carries]
            for k, values in parts:
                if last is not None and k != last:
                    states = [None] * len(carries)
                last, moved = k, []
                for m, c, s, v in zip(made, carries, states, values, strict=True):
                    s, (out,) = c.step(s, v)
                    m.append(out)
                    moved.append(s)
                states = moved
            new = [pa.array(np.concatenate(m), kinds[t][1], from_pandas=True) for m, t in zip(made, outputs.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*names, *outputs])

    return dealt.mapInArrow(finished, StructType([*df.schema.fields, *(StructField(o, kinds[t][0]) for o, t in outputs.items())]))
