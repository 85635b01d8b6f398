"""Bars and timelines: resampling, flooring, alignment of sources of different frequency."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.windows import Series

HOUR, DAY = 3600, 86400
FREQUENCIES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": HOUR, "2h": 2 * HOUR, "4h": 4 * HOUR, "6h": 6 * HOUR, "8h": 8 * HOUR, "12h": 12 * HOUR, "1d": DAY}


def epoch(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def floor_time(t: Column, seconds: int) -> Column:
    return (F.floor(t / seconds) * seconds).cast("long")


def bars(events: DataFrame, seconds: int = 4 * HOUR, key: str = "event_type", ts: str = "ts", value: str = "value", taker: Column | None = None, tie: str | None = "event_id") -> DataFrame:
    """Open, high, low, close, volume (events), turnover and taker volume per key and interval; one shuffle, partial sums.

    Among events of one time ``tie`` tells which comes first, where there is such a column, else the value.
    """
    first = F.struct(ts, tie if tie in events.columns else value)
    taker = F.col(value) > 50 if taker is None else taker
    return events.groupBy(F.col(key).alias("sym"), floor_time(epoch(ts), seconds).alias("t")).agg(
        F.min_by(value, first).alias("o"),
        F.max(value).alias("h"),
        F.min(value).alias("l"),
        F.max_by(value, first).alias("c"),
        F.count("*").cast("double").alias("v"),
        F.sum(value).alias("n"),
        F.count_if(taker).cast("double").alias("tb"),
    )


def resample(df: DataFrame, seconds: int, how: dict[str, str], key: str = "sym", t: str = "t") -> DataFrame:
    """Left-closed bins with last, first, mean or sum of each column (nulls skipped); empty bins are dropped."""
    rule = {
        "last": lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(t))),
        "first": lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(t))),
        "mean": F.avg,
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
    }
    out = df.groupBy(key, floor_time(F.col(t), seconds).alias(t)).agg(*[rule[h](c).alias(c) for c, h in how.items()])
    return out.dropna("all", subset=list(how))


def timeline(df: DataFrame, seconds: int, key: str = "sym", t: str = "t") -> DataFrame:
    """Every grid time between a key's first and last row."""
    ends = df.groupBy(key).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    return ends.select(key, F.explode(F.sequence(floor_time(F.col("a"), seconds), F.col("b"), F.lit(seconds).cast("long"))).alias(t))


def keep_one(df: DataFrame, key: list[str], order: str, last: bool = True) -> DataFrame:
    """One row for each key: the last (or first) by ``order``."""
    by = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(by(F.struct(*rest), order).alias("r")).select(*key, *[f"r.{c}" for c in rest])


def asof(left: DataFrame, right: DataFrame, key: list[str], t: str = "t", forward: bool = False) -> DataFrame:
    """Each left row with the last right row at or before it (or the next at or after it).

    The row is taken whole: a null inside it stays null. One shuffle by key:
    both sides are stacked and read in order, nothing is joined by range.
    """
    payload = [c for c in right.columns if c not in (*key, t)]
    lhs = left.select(*key, t, F.struct(*[F.col(c) for c in left.columns if c not in (*key, t)]).alias("l"), F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("r"), F.lit(1).alias("side"))
    rhs = right.select(*key, t, F.lit(None).cast(lhs.schema["l"].dataType).alias("l"), F.struct(*payload).alias("r"), F.lit(0).alias("side"))
    both = lhs.unionByName(rhs)
    w = Window.partitionBy(*key)
    w = w.orderBy(F.col(t).desc(), F.col("side")) if forward else w.orderBy(t, "side")
    found = F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("r", found).where("side = 1")
    return out.select(*key, t, *[f"l.{c}" for c in left.columns if c not in (*key, t)], *[f"r.{c}" for c in payload])


def fill(df: DataFrame, columns: list[str], limit: int | None = None, back: bool = False, zero: bool = False, key: str = "sym", t: str = "t") -> DataFrame:
    """Forward fill (at most ``limit`` rows), then, as asked, backward fill and zeros. Backward fill reads the future."""
    s = Series(key, t)
    out = {}
    for c in columns:
        x = s.ffill(c, limit)
        if back:
            x = F.coalesce(x, F.first(c, ignorenulls=True).over(s.o.rowsBetween(0, Window.unboundedFollowing)))
        out[c] = F.coalesce(x, F.lit(0.0)) if zero else x
    return df.select(*[out.get(c, F.col(c)).alias(c) for c in df.columns])


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def master(price: DataFrame, sources: dict[str, DataFrame], key: str = "sym", t: str = "t", limit: int = 24, share: float = 0.5) -> DataFrame:
    """Price rows with the latest row of every source (columns prefixed by its name), gaps filled up to
    ``limit`` bars, rows with fewer than ``share`` of all columns non-null dropped."""
    out = price
    for name, df in sources.items():
        if len(df.columns) > 2:
            out = asof(out, prefixed(keep_one(df, [key, t], t), f"{name}_", [key, t]), [key], t)
    extra = [c for c in out.columns if c not in price.columns]
    out = fill(out, extra, limit, key=key, t=t)
    return out.dropna(thresh=int(len(out.columns) * share))


def outer_on_time(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Full outer join of several frames on their key (horizontal concatenation); shared columns keep the first."""
    seen: set[str] = set(key)
    cut = []
    for f in frames:
        cut.append(f.select(*key, *[c for c in f.columns if c not in seen]))
        seen |= set(f.columns)
    return functools.reduce(lambda a, b: a.join(b, key, "full_outer"), cut)


#: Rows of a stretch of a series, about, and the stretches of time that are counted for it.
STRETCH_ROWS, COUNTED = 1_000_000, 30 * DAY


def in_stretches(df: DataFrame, build: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, rows: int = STRETCH_ROWS, seconds: int = COUNTED) -> DataFrame:
    """``build(df)``, with long series cut into stretches of about ``rows`` rows that different tasks compute.

    ``build`` adds columns to bars (sym, t) by windows that reach at most
    ``back`` rows back and ``ahead`` rows on. Each stretch gets that many rows of
    its neighbours as context (whole stretches of time of ``seconds``), which go
    again afterwards, so the result is that of the uncut series. Only counts by
    series and time are gathered to place the cuts.
    """
    base = df.withColumn("_bucket", F.floor(F.col("t") / seconds))
    w, whole = Window.partitionBy("sym").orderBy("_bucket"), Window.partitionBy("sym")
    counts = base.groupBy("sym", "_bucket").agg(F.count("*").alias("n"))
    counts = counts.select("*", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), (F.max("n").over(whole) + max(back, ahead) + 1).alias("least"))
    counts = counts.withColumn("own", F.floor((F.col("upto") - F.col("n")) / F.greatest(F.lit(rows), F.col("least"))))
    ends = Window.partitionBy("sym", "own")
    counts = counts.select("*", F.min(F.col("upto") - F.col("n")).over(ends).alias("first"), F.max("upto").over(ends).alias("last"))
    after = F.when(F.col("last") - F.col("upto") < back, F.col("own") + 1)
    before = F.when((F.col("upto") - F.col("n") - F.col("first") < ahead) & (F.col("own") > 0), F.col("own") - 1)
    placed = counts.select("sym", "_bucket", "own", F.array_compact(F.array("own", after, before)).alias("at"))
    dealt = base.join(placed, ["sym", "_bucket"]).select(*df.columns, "own", F.explode("at").alias("_at"))
    dealt = dealt.select(F.col("sym").alias("_sym"), F.concat("sym", F.lit("#"), F.col("_at")).alias("sym"), *[c for c in df.columns if c != "sym"], (F.col("own") == F.col("_at")).alias("_mine"))
    out = build(dealt).where("_mine")
    return out.select(F.col("_sym").alias("sym"), *[c for c in out.columns if c not in ("_sym", "sym", "_mine")])
