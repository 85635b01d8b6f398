"""Line plots as PNG without a plotting library: a picture for each series, drawn in tasks from one row a pixel column."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.package import send

WHITE, GREY, BLUE, RED = (255, 255, 255), (220, 220, 220), (31, 119, 180), (214, 39, 40)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray) -> bytes:
    """An array (rows, columns, 3) of bytes as PNG."""
    h, w, _ = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def equity_curve(equity: list[float], drawdown: list[float] | None = None, width: int = 800, height: int = 400) -> bytes:
    """Equity as a line over a grid, and drawdown as a filled band below it if given. Nulls leave gaps."""
    pixels = np.full((height, width, 3), WHITE, np.uint8)
    pixels[:: max(1, height // 8)] = GREY
    top = height if drawdown is None else int(height * 0.75)
    x = np.linspace(0, max(len(equity) - 1, 0), width).round().astype(int)
    y = np.array([np.nan if v is None else v for v in equity], float)
    if len(y) and np.isfinite(y).any():
        lo, hi = np.nanmin(y), np.nanmax(y)
        rows = (top - 1 - (y[x] - lo) / ((hi - lo) or 1) * (top - 1)).round()
        before = rows[0]
        for c, r in enumerate(rows):
            if np.isfinite(r):
                a, b = sorted((int(r), int(before if np.isfinite(before) else r)))
                pixels[a : b + 1, c] = BLUE
            before = r
    if drawdown is not None and len(drawdown):
        d = np.array([0.0 if v is None else v for v in drawdown], float)
        worst = min(d.min(), -1e-12)
        for c, k in enumerate(x):
            pixels[top : top + int(d[k] / worst * (height - top - 1)) + 1, c] = RED
    return encode(pixels)


def pictures(df: DataFrame, equity: str, key: str = "sym", order: str = "t", width: int = 800, height: int = 400) -> DataFrame:
    """``key``, png: each series' equity with its drawdown from the peak so far.

    A series of any length is reduced to the last equity and the worst drawdown
    of each pixel column before it is drawn.
    """
    send(df.sparkSession)
    past = Window.partitionBy(key).orderBy(order)
    n, place = F.count("*").over(Window.partitionBy(key)), F.row_number().over(past) - 1
    peak = F.max(equity).over(past.rowsBetween(Window.unboundedPreceding, 0))
    at = df.where(F.col(equity).isNotNull()).select(F.col(key), F.col(order), F.col(equity).cast("double").alias("e"), (F.try_divide(F.col(equity), peak) - 1).alias("d"), F.floor(place * width / F.greatest(n, F.lit(width))).alias("x"))
    column = at.groupBy(key, "x").agg(F.max_by("e", order).alias("e"), F.min("d").alias("d"))
    lines = column.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("x", "e", "d"))).alias("line"))  # a row for each pixel column
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            drawn = [equity_curve([p["e"] for p in line], [p["d"] for p in line], width, height) for line in b.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(drawn, pa.binary())], [key, "png"])

    return lines.mapInArrow(run, f"{key} {kind}, png binary")
