"""Conjunctions of conditions by bit vectors: no row for each bar and set of conditions.

The bars of a stretch of a series are bits of one vector for each condition.
A set of conditions is the AND of its vectors, its size a count of bits, and
sums over its bars are products with the unpacked vector.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions.package import send

#: Bars of a stretch, and sets whose vectors are unpacked at once.
STRETCH, SETS = 2048, 1024
_SUMS = ("n", "r", "rr", "wins", "gain", "loss", "log", "negative", "zero")


def _sums_of(r: np.ndarray) -> np.ndarray:
    """What is summed over bars for a trade's return r: itself, its square, wins, gains, losses, and the parts of the product of 1 + r."""
    grown = 1 + r
    return np.stack([np.ones(len(r)), r, r * r, r > 0, np.maximum(r, 0), np.minimum(r, 0), np.log(np.where(grown == 0, 1, np.abs(grown))), grown < 0, grown == 0], axis=1)


def _sets(names: list[str], size: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(len(names)), size)), np.int64).reshape(-1, size)


def set_sums(hits: DataFrame, names: list[str], size: int, cost: float, unanimous: bool = True) -> DataFrame:
    """Partial sums of every set of ``size`` names, by stretch: sym, oos, config, direction, indicators and the sums.

    ``hits``: sym, oos, i (bar number), config, side (-1 or 1), indicator, ret:
    a row where an indicator fires. A set fires where all its members (or more
    than half) do on one side. Trades are side * direction * ret - cost.
    """
    send(hits.sparkSession)
    names = sorted(names)
    place = {n: k for k, n in enumerate(names)}
    sets = _sets(names, size)
    labels = np.array(["+".join(names[k] for k in s) for s in sets], object)
    fields = "sym {sym}, oos boolean, config string, direction int, indicators string, " + ", ".join(f"{s} double" for s in _SUMS)
    kind = hits.schema["sym"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        config, side = table.column("config").to_numpy(zero_copy_only=False), table.column("side").to_numpy()
        bars, first, at = np.unique(table.column("i").to_numpy(), return_index=True, return_inverse=True)
        ret = table.column("ret").to_numpy(zero_copy_only=False).astype(float)[first]
        who = np.array([place.get(x, -1) for x in table.column("indicator").to_pylist()])
        known = {s: _sums_of(s * ret - cost) for s in (1, -1)}
        out: list[tuple] = []
        for c in sorted(set(config.tolist())):
            for s in (1, -1):
                mine = (config == c) & (side == s) & (who >= 0)
                if not mine.any():
                    continue
                bits = np.zeros((len(names), len(bars)), bool)
                bits[who[mine], at[mine]] = True
                packed = np.packbits(bits, axis=1)
                for k in range(0, len(sets), SETS):
                    some = sets[k : k + SETS]
                    if unanimous:
                        both = np.bitwise_and.reduce(packed[some], axis=1)
                        live = np.flatnonzero(np.bitwise_count(both).sum(axis=1))
                        mask = np.unpackbits(both[live], axis=1, count=len(bars)).astype(float)
                    else:
                        votes = bits[some].sum(axis=1) * 2 > size
                        live = np.flatnonzero(votes.any(axis=1))
                        mask = votes[live].astype(float)
                    for d in (1, -1):
                        for label, row in zip(labels[k + live], (mask @ known[s * d]).tolist(), strict=True):
                            out.append((c, d, label, *row))
        cols = list(zip(*out, strict=True)) if out else [[] for _ in range(3 + len(_SUMS))]
        n = len(out)
        keys = {"sym": pa.chunked_array([pa.array([table.column("sym")[0].as_py()] * n, table.schema.field("sym").type)]), "oos": pa.array([table.column("oos")[0].as_py()] * n, pa.bool_())}
        values = {"config": pa.array(cols[0], pa.string()), "direction": pa.array(cols[1], pa.int32()), "indicators": pa.array(cols[2], pa.string())}
        return pa.table(keys | values | {s: pa.array(v, pa.float64()) for s, v in zip(_SUMS, cols[3:], strict=True)})

    at = hits.select("sym", "oos", F.floor(F.col("i") / STRETCH).alias("stretch"), "i", "config", "side", "indicator", F.col("ret").cast("double").alias("ret"))
    return at.groupBy("sym", "oos", "stretch").applyInArrow(run, fields.format(sym=kind))


def set_figures(sums: DataFrame, days: DataFrame) -> DataFrame:
    """In-sample and out-of-sample figures (as of trades by ``search``) from partial sums and the days of each part."""
    key = ["sym", "indicators", "config", "direction"]
    total = sums.groupBy(*key, "oos").agg(*[F.sum(s).alias(s) for s in _SUMS]).join(days, ["sym", "oos"])
    n, mean = F.col("n"), F.col("r") / F.col("n")
    spread = F.greatest(F.col("rr") / n - mean * mean, F.lit(0.0))
    product = F.when(F.col("zero") > 0, 0.0).otherwise(F.when(F.col("negative") % 2 == 1, -1.0).otherwise(1.0) * F.exp("log"))
    daily = F.when(product > 0, F.pow(product, 1 / F.col("days")) - 1).otherwise(-1.0)
    width = F.sqrt(spread) * F.sqrt(n / F.col("days"))
    figures = {
        "n": n.cast("long"),
        "sharpe": F.coalesce(F.when((n >= 2) & (width >= 1e-10), F.try_divide(daily, width) * 365**0.5), F.lit(0.0)),
        "win": F.col("wins") / n,
        "mean": mean,
        "profit_factor": F.col("gain") / (F.abs("loss") + 1e-10),
        "std": F.when(n > 1, F.sqrt(spread * n / (n - 1))),
    }
    total = total.select(*key, "oos", *[v.alias(k) for k, v in figures.items()])
    part = lambda k, o: F.max(F.when(F.col("oos") == o, F.col(k)))
    none = {"n": 0, "sharpe": 0.0}  # what an empty part counts as
    out = [(F.coalesce(part(k, o), F.lit(none[k])) if k in none else part(k, o)).alias(f"{p}_{k}") for o, p in ((False, "is"), (True, "oos")) for k in figures]
    return total.groupBy(*key).agg(*out)


def spaced_pairs(hits: DataFrame, holding: int = 6) -> DataFrame:
    """sym, a, b, support, wins, known, total: of every two conditions of a series on different indicators, the trades where both hold, taken greedily ``holding`` bars apart.

    ``hits``: sym, i (bar number), ret, k (number of a condition in its series),
    indicator. A trade of unknown return counts as no win; ``known`` ones make ``total``. A series is a stream of stretches; what goes from one to the next
    is the first free bar of each pair.
    """
    send(hits.sparkSession)
    kind = hits.schema["sym"].dataType.simpleString()

    def run(batches):
        series, rows, state = None, [], {}

        def closed():
            """The pairs of one stretch, added to the state of the series."""
            i, k = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
            ret = np.array([r[1] for r in rows], float)  # unknown: nan
            names = {r[2]: r[3] for r in rows}
            bars, first, at = np.unique(i, return_index=True, return_inverse=True)
            order = sorted(names)
            where = {c: n for n, c in enumerate(order)}
            bits = np.zeros((len(order), len(bars)), bool)
            bits[[where[c] for c in k.tolist()], at] = True
            packed = np.packbits(bits, axis=1)
            gains = ret[first]
            for a, b in itertools.combinations(order, 2):
                if names[a] == names[b]:
                    continue
                places = np.flatnonzero(np.unpackbits(packed[where[a]] & packed[where[b]], count=len(bars)))
                if not len(places):
                    continue
                free, n, wins, known, total = state.get((a, b), (-np.inf, 0, 0, 0, 0.0))
                when, p = bars[places], 0
                while (p := int(np.searchsorted(when, free))) < len(when):
                    r = gains[places[p]]
                    n, wins, free = n + 1, wins + int(r > 0), when[p] + holding
                    if r == r:
                        known, total = known + 1, total + float(r)
                state[a, b] = (free, n, wins, known, total)

        def sent():
            cols = list(zip(*((a, b, n, w, m, t) for (a, b), (_, n, w, m, t) in state.items()), strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([series] * len(state), batch_kind), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["sym", "a", "b", "support", "wins", "known", "total"])

        batch_kind = None
        for batch in batches:
            batch_kind = batch.column("sym").type
            for sym, *r in zip(*(batch.column(c).to_pylist() for c in ("sym", "i", "ret", "k", "indicator")), strict=True):
                if rows and (sym != series or r[0] >= rows[0][0] + STRETCH):
                    closed()
                    rows = []
                if sym != series:
                    if state:
                        yield sent()
                    series, state = sym, {}
                rows.append(r)
        if rows:
            closed()
        if state:
            yield sent()

    dealt = hits.select("sym", "i", F.col("ret").cast("double").alias("ret"), "k", "indicator").repartition("sym").sortWithinPartitions("sym", "i", "k")
    return dealt.mapInArrow(run, f"sym {kind}, a int, b int, support long, wins long, known long, total double")
