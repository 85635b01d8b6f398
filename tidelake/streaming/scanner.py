"""A scanner that keeps its bars as state: events of a stream become bars, rolling features, scores and alerts.

A symbol's state is its open bars, the closes of the last finished ones, and
the time of its last alert. A timer at a bar's end closes it when the
watermark passes; bars close in order of time, each with the events that came
before that, late ones included. State is bounded by the look-back and by the
bars that the watermark still holds open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelake.functions.package import send
from tidelake.functions.windows import Series
from tidelake.operators.features import apply

OUT = "sym string, t long, c double, n long, mean double, score double, alert boolean"


class Scanner(StatefulProcessor):
    def __init__(self, size: int, back: int, least: float, cooldown: int):
        self.size, self.back, self.least, self.cooldown = size, back, least, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "t long", "ts double, id long, c double, n long")
        self.closes = handle.getListState("closes", "c double")
        self.alerted = handle.getValueState("alerted", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            f = f.sort_values(["at", "id"])
            for start, part in f.groupby(f["at"] // self.size * self.size):
                start, last = int(start), part.iloc[-1]
                held = self.open.getValue((start,)) if self.open.containsKey((start,)) else None
                n = len(part) + (held[3] if held else 0)
                newest = (float(last["at"]), int(last["id"]), float(last["value"]))
                if held and (held[0], held[1]) > newest[:2]:
                    newest = tuple(held[:3])
                if held is None:
                    self.handle.registerTimer((start + self.size) * 1000)
                self.open.updateValue((start,), (*newest, n))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        done = sorted(k[0] for k in self.open.keys() if k[0] + self.size <= now)
        out = []
        closes = [x[0] for x in self.closes.get()]
        last = self.alerted.get()[0] if self.alerted.exists() else None
        for t in done:
            _, _, c, n = self.open.getValue((t,))
            self.open.removeKey((t,))
            closes = [*closes, c][-self.back :]
            mean = score = None
            if len(closes) == self.back:
                mean = sum(closes) / self.back
                sd = math.sqrt(sum((x - mean) ** 2 for x in closes) / (self.back - 1)) if self.back > 1 else 0.0
                score = (c - mean) / sd if sd > 0 else None
            alert = score is not None and abs(score) >= self.least and (last is None or t - last >= self.cooldown)
            last = t if alert else last
            out.append((key[0], t, c, n, mean, score, alert))
        if done:
            self.closes.put([(x,) for x in closes])
            if last is not None:
                self.alerted.update((last,))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")]).astype({"mean": float, "score": float}) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def scanned(events: DataFrame, size: int = 4 * 3600, back: int = 24, least: float = 1.5, cooldown: int = 4 * 3600, late: str = "1 hour", key: str = "event_type", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Bars of a stream (ts a timestamp) with their rolling score and alerts: sym, t, close, events, mean, score, alert.

    The score is the close's distance from the mean of the last ``back``
    closes in their deviations; an alert is a score of ``least`` in size,
    ``cooldown`` seconds after the last one at least. Bars that the watermark
    has not passed are still open. The session needs a state store with
    timers and several columns (RocksDB).
    """
    send(events.sparkSession)
    rows = events.withWatermark("ts", late).select(F.col(key).alias("sym"), "ts", F.col("ts").cast("double").alias("at"), F.col(tie).cast("long").alias("id"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("sym").transformWithStateInPandas(Scanner(size, back, least, cooldown), OUT, "append", "eventTime")


def scanned_table(bars: DataFrame, back: int = 24, least: float = 1.5, cooldown: int = 4 * 3600) -> DataFrame:
    """The same over a table of bars (sym, t, c, n): the features by windows, the cooldown in one sorted pass."""
    import numpy as np

    from tidelake.functions.scan import scan

    s = Series("sym", "t")
    df = apply(bars, {"mean": s.mean("c", back), "_sd": s.std("c", back)})
    df = apply(df, {"score": F.when(F.col("_sd") > 0, (F.col("c") - F.col("mean")) / F.col("_sd"))}).drop("_sd")

    def step(last, t, score):
        last, out = -(2.0**62) if last is None else last, np.zeros(len(t), np.int64)
        for i in np.flatnonzero(np.abs(np.nan_to_num(score)) >= least).tolist():
            if t[i] - last >= cooldown:
                out[i], last = 1, t[i]
        return last, [out]

    df = scan(df, ["sym"], ["t"], ["t", "score"], {"_a": "long"}, step)
    return df.select("sym", "t", "c", "n", "mean", "score", (F.col("_a") == 1).alias("alert"))
