"""First passages and conjunctions against plain loops."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tidelake.operators import bitmaps, passage
from tidelake.operators import search as sc
from tidelake.operators import targets as tg


@pytest.mark.parametrize("block", [20_000, 7])
def test_exits_by_plain_loops(spark, monkeypatch, block):
    rng = np.random.default_rng(1)
    bars = []
    for sym, n in (("a", 60), ("b", 1), ("c", 45)):
        c = 100 * np.exp(np.cumsum(rng.normal(size=n) * 0.02))
        for i in range(n):
            bars.append([sym, i, float(c[i] * (1 + rng.random() * 0.02)), float(c[i] * (1 - rng.random() * 0.02)), float(c[i])])
    bars[10][2] = bars[20][3] = bars[30][4] = None
    monkeypatch.setattr(passage, "BLOCK", block)
    pairs, horizons = [(1.0, 2.0), (2.5, 2.0), (1.0, 4.0)], [3, 10, 20]
    for direction in (1, -1):
        df = spark.createDataFrame(bars, "sym string, t long, h double, l double, c double").repartition(3)
        got = {(r.sym, r.t): r for r in tg.exits(df, pairs, horizons, direction).collect()}
        assert len(got) == len(bars)
        for sym in "abc":
            path = [b for b in bars if b[0] == sym]
            for i, (_, t, _, _, c) in enumerate(path):
                for (sl, tp), k in itertools.product(pairs, horizons):
                    kind = at = ret = None
                    for j, (_, _, h, l, _) in enumerate(path[i + 1 : i + 1 + k], 1):  # noqa: E741
                        bad, good = (l, h) if direction > 0 else (h, l)
                        stop = c is not None and bad is not None and (bad - c * (1 - direction * sl / 100)) * direction <= 0
                        take = c is not None and good is not None and (good - c * (1 + direction * tp / 100)) * direction >= 0
                        if stop or take:
                            kind, at, ret = (-1, j, -sl / 100) if stop else (1, j, tp / 100)
                            break
                    if kind is None and i + k < len(path):
                        end = path[i + k][4]
                        kind, at, ret = 0, k, None if c is None or end is None else direction * (end / c - 1)
                    r, n = got[sym, t], f"exit_sl{sl:g}_tp{tp:g}_{k}h"
                    assert (r[f"{n}_type"], r[f"{n}_bars"]) == (kind, at)
                    assert (r[f"{n}_return"] is None) == (ret is None) and (ret is None or abs(r[f"{n}_return"] - ret) < 1e-12)


def test_sets_of_many_indicators(spark, monkeypatch):
    """Sums of sets, unanimous and by majority, over stretches, against boolean arrays."""
    rng = np.random.default_rng(5)
    names, n = [f"x{i:02d}" for i in range(24)], 900
    side = rng.integers(-1, 2, size=(24, n))
    ret = rng.normal(size=n) * 0.5
    ret[3] = -0.9988 - 1e-9  # 1 + r is about zero
    rows = [("s", bool(i >= 600), i, "pct", int(side[k, i]), names[k], float(ret[i])) for k in range(24) for i in range(n) if side[k, i]]
    hits = spark.createDataFrame(rows, "sym string, oos boolean, i long, config string, side int, indicator string, ret double")
    monkeypatch.setattr(bitmaps, "STRETCH", 250)
    monkeypatch.setattr(bitmaps, "SETS", 100)
    days = spark.createDataFrame([("s", False, 100.0), ("s", True, 50.0)], "sym string, oos boolean, days double")
    for size, unanimous in ((2, True), (3, False)):
        got = {(r.indicators, r.direction): r for r in bitmaps.set_figures(bitmaps.set_sums(hits, names, size, 0.0012, unanimous), days).collect()}
        rng2 = np.random.default_rng(9)
        for _ in range(40):
            some = sorted(rng2.choice(24, size, replace=False).tolist())
            for d in (1, -1):
                trades = []
                for i in range(n):
                    for s in (1, -1):
                        agree = int((side[some, i] == s).sum())
                        if agree == size or (not unanimous and agree * 2 > size):
                            trades.append((i >= 600, s * d * ret[i] - 0.0012))
                r = got["+".join(names[k] for k in some), d]
                for part, tag, span in ((False, "is", 100.0), (True, "oos", 50.0)):
                    x = np.array([v for o, v in trades if o == part])
                    assert r[f"{tag}_n"] == len(x)
                    if len(x) > 1:
                        total = np.prod(1 + x)
                        daily = total ** (1 / span) - 1 if total > 0 else -1.0
                        assert abs(r[f"{tag}_sharpe"] - daily / (x.std() * math.sqrt(len(x) / span)) * math.sqrt(365)) < 1e-6
                        assert abs(r[f"{tag}_win"] - (x > 0).mean()) < 1e-12 and abs(r[f"{tag}_std"] - x.std(ddof=1)) < 1e-9
                        assert abs(r[f"{tag}_profit_factor"] - x[x > 0].sum() / (abs(x[x < 0].sum()) + 1e-10)) < 1e-6


def test_pairs_of_the_best_rules(spark):
    """Pairs come only from the best rules of each series, trades are spaced over stretches, both sides are rules."""
    rng = np.random.default_rng(7)
    n = 3000
    x = rng.normal(size=(n, 3))
    up = (x[:, 0] > 0.7) & (x[:, 1] < -0.2)
    df = spark.createDataFrame(pd.DataFrame({"sym": "s", "t": np.arange(n), "ret": np.where(up, 0.02, -0.004) + rng.normal(size=n) * 1e-3, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    got = {(r.a, r.b): r for r in sc.pair_rules(df, ["a", "b", "c"], min_trades=20, min_win=0.6, base=8, base_trades=20, base_win=0.5).collect()}
    single = sorted(sc.mine(df, ["a", "b", "c"], min_trades=20, min_win=0.5).collect(), key=lambda r: (-r.confidence, -r.support, r.indicator, r.op, r.pct))[:8]
    held = {f"{r.indicator}{r.op}{r.pct}": (x[:, "abc".index(r.indicator)] > r.threshold) if r.op == ">" else (x[:, "abc".index(r.indicator)] < r.threshold) for r in single}
    ret = np.array([r.ret for r in df.orderBy("t").collect()])
    want = {}
    for p, q in itertools.combinations(sorted(held), 2):
        if p[0] == q[0]:
            continue
        free, trades = -1, []
        for i in np.flatnonzero(held[p] & held[q]):
            if i >= free:
                trades.append(ret[i])
                free = i + 6
        win = np.mean(np.array(trades) > 0) if trades else 0
        if len(trades) >= 20 and (win >= 0.6 or win <= 0.4):
            want[p, q] = (len(trades), win, np.mean(trades), 1 if win >= 0.5 else -1, max(win, 1 - win))
    assert got.keys() == want.keys() and len(want) > 2
    assert all(np.allclose([r.support, r.win, r.mean, r.direction, r.confidence], want[k]) for k, r in got.items())
