"""Groups of rows that are compared with one another: dealing of large ones, and reading them from a sorted stream."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import checkpointed

#: Keys of large groups that are broadcast, at most (16 bytes each).
MAX_SENT = 500_000


def parted(rows: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """Rows with the pair of parts (p, q) in which they are compared, and their own part.

    A group of at most ``most`` rows is one part: (0, 0). A larger one is cut
    into parts by a hash of ``by``, and each row goes to every pair of parts
    that its own is in: any two rows of a group meet in the pair of their
    parts, and no task holds more than about two parts.
    """
    large = checkpointed(rows.groupBy(key).agg(F.count("*").alias("size")).where(F.col("size") > most))
    n = large.count()
    if not n:
        return rows.select("*", *[F.lit(0).alias(c) for c in ("p", "q", "part")])
    sized = rows.join(F.broadcast(large) if n <= MAX_SENT else large, key, "left")
    parts = F.ceil(F.coalesce("size", F.lit(1)) / most).cast("int")
    sized = sized.select(*rows.columns, parts.alias("parts"), F.pmod(F.xxhash64(by, F.lit(17)), parts).cast("int").alias("part"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = sized.select(*rows.columns, "part", other.alias("other"))
    return dealt.select(*rows.columns, F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part")


def groups(batches, *columns: str):
    """Arrow tables of whole groups of a stream sorted by ``columns``, each with the places where groups begin."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        cols = [t.column(c).to_numpy() for c in columns]
        first = np.flatnonzero(np.r_[True, functools.reduce(np.logical_or, [c[1:] != c[:-1] for c in cols])])
        if first[-1]:
            yield t.slice(0, first[-1]), first[:-1]
        held = t.slice(first[-1])
    if held is not None:
        yield held, np.zeros(1, np.int64)
