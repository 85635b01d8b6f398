"""First passage of price levels: when a low, or a high, ahead first touches a level that hangs on each bar's close.

Lows and highs get tables of minima and maxima over windows of every power of
two; a level is found by halving, so a bar costs the logarithm of the horizon
for each distinct level, whatever the number of pairs and horizons that are
read from the touches afterwards. A series is a stream of bounded blocks that
overlap by the horizon.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidelake.functions.package import send
from tidelake.functions.scan import _changes

#: Bars that are worked on at once, besides those ahead of them.
BLOCK = 20_000


def tables(values: np.ndarray, far: int) -> list[np.ndarray]:
    """Minima of the windows of 1, 2, 4 ... values that begin at each place, up to half of ``far``; beyond the end there is nothing (inf)."""
    out, n = [np.append(values, np.inf)], len(values)
    while 2 ** len(out) <= far:
        last, half = out[-1], 2 ** (len(out) - 1)
        later = np.full(n + 1, np.inf)
        later[: max(0, n + 1 - half)] = last[half:]
        out.append(np.minimum(last, later))
    return out


def first_at_most(minima: list[np.ndarray], level: np.ndarray, far: int) -> np.ndarray:
    """For each place i the least k in 1..far with value i + k at most level i, else 0."""
    n = len(minima[0]) - 1
    start = np.arange(len(level))
    pos = start + 1
    for k in range(len(minima) - 1, -1, -1):
        pos = np.where(minima[k][np.minimum(pos, n)] > level, pos + 2**k, pos)
    pos = np.minimum(pos, n)
    with np.errstate(invalid="ignore"):
        return np.where((minima[0][pos] <= level) & (pos - start <= far), pos - start, 0)


def touches(df: DataFrame, levels: dict[str, tuple[str, float]], far: int, ends: tuple[int, ...] = (), key: str = "sym", order: str = "t") -> DataFrame:
    """``df`` (h, l, c) with a column for each level: bars until it is first touched, 0 if it isn't within ``far``.

    ``levels``: column -> (side, factor): low: a low at most factor times the
    close; high: a high at least that. ``_ahead``: bars that follow in the
    series, ``far`` at most; ``_end_k``: the close ``k`` bars ahead. A missing
    value is never touched and touches nothing.
    """
    send(df.sparkSession)
    names = df.columns
    prices = [names.index(c) for c in ("h", "l", "c")]
    at = names.index(key)

    def worked(table: pa.Table, own: int) -> pa.RecordBatch:
        h, l, c = (table.column(k).to_numpy(zero_copy_only=False).astype(float) for k in prices)  # noqa: E741
        low, high = tables(np.where(np.isnan(l), np.inf, l), far), tables(np.where(np.isnan(h), np.inf, -h), far)
        out = [first_at_most(low, c[:own] * f, far) if side == "low" else first_at_most(high, -(c[:own] * f), far) for side, f in levels.values()]
        ahead = np.minimum(len(c) - 1 - np.arange(own), far)
        later = [np.append(c[k:], np.full(k, np.nan))[:own] for k in ends]
        new = [pa.array(x, pa.int32()) for x in (*out, ahead)] + [pa.array(x, pa.float64(), from_pandas=True) for x in later]
        mine = table.slice(0, own).combine_chunks()
        return pa.RecordBatch.from_arrays([*(col.chunk(0) if col.num_chunks else pa.array([], col.type) for col in mine.columns), *new], [*names, *levels, "_ahead", *(f"_end_{k}" for k in ends)])

    def run(batches):
        held, series = None, None
        for b in batches:
            if not b.num_rows:
                continue
            cuts = [0, *_changes([b.column(at)]), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                part = pa.Table.from_batches([b.slice(i, j - i)])
                if held is not None and series != b.column(at)[i].as_py():
                    yield worked(held, held.num_rows)
                    held = None
                series = b.column(at)[i].as_py()
                held = part if held is None else pa.concat_tables([held, part])
                while held.num_rows >= BLOCK + far:
                    yield worked(held.slice(0, BLOCK + far), BLOCK)
                    held = held.slice(BLOCK)
        if held is not None:
            yield worked(held, held.num_rows)

    fields = [StructField(k, IntegerType()) for k in (*levels, "_ahead")] + [StructField(f"_end_{k}", DoubleType()) for k in ends]
    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, StructType([*df.schema.fields, *fields]))
