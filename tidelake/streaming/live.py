"""Streams: bars with watermarks, alerts with a cooldown held as state, and sinks per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelake.functions.scan import scan
from tidelake.operators.bars import HOUR, epoch


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def stream_bars(events: DataFrame, size: str = "4 hours", late: str = "1 hour", key: str = "event_type", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Bars of a stream; rows later than ``late`` behind the newest are dropped, closed bars are final. ``tie`` orders events of one time."""
    first = F.struct("ts", tie)
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), F.col(key).alias("sym"))
    out = w.agg(F.min_by(value, first).alias("o"), F.max(value).alias("h"), F.min(value).alias("l"), F.max_by(value, first).alias("c"), F.count("*").cast("double").alias("v"))
    return out.select("sym", epoch("window.start").alias("t"), "o", "h", "l", "c", "v")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    return w.agg(F.count("*").alias("n")).select(key, epoch("session_window.start").alias("t"), "n")


def unique_events(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def cooled(alerts: DataFrame, seconds: int = 4 * HOUR) -> DataFrame:
    """Alerts (sym, t, score) of a stream that come ``seconds`` after the last one that passed; one number of state per symbol.

    The rows of a symbol in one micro-batch are taken in order of time, whatever
    order they arrive in; of equal times the smallest score. What a later batch
    brings from before the last alert is late and dropped.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -(2**62)
        rows = pd.concat(list(frames)).sort_values(["t", "score"])
        keep = []
        for t in rows["t"]:
            keep.append(t - last >= seconds)
            last = t if keep[-1] else last
        state.update((int(last),))
        yield rows[keep][["sym", "t", "score"]]

    return alerts.groupBy("sym").applyInPandasWithState(step, "sym string, t long, score double", "last long", "append", GroupStateTimeout.NoTimeout)


def gated(df: DataFrame, score: str, least: float, seconds: int = 4 * HOUR) -> DataFrame:
    """The same gate over a table: confident rows that keep the cooldown, in one sorted pass."""
    import numpy as np

    def step(state, t):
        last, keep = state if state is not None else -(2.0**62), np.zeros(len(t), np.int64)
        for i, x in enumerate(t.tolist()):
            if x - last >= seconds:
                keep[i], last = 1, x
        return last, [keep]

    sure = df.where(F.col(score) >= least).select("sym", "t", F.col(score).alias("score"))
    return scan(sure, ["sym"], ["t"], ["t"], {"keep": "long"}, step).where("keep = 1").drop("keep")


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there, into Parquet, and stop."""
    df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Hand every micro-batch to a sink (alerts, a feature recompute)."""
    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def message(rule: Column, side: Column, score: Column) -> Column:
    """The text of an alert."""
    return F.format_string("%s %s (%.2f)", F.when(side > 0, "LONG").otherwise("SHORT"), rule, score)
