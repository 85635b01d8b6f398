"""Boosted trees against a plain booster on the same bins, and attributions against Shapley values over subsets."""

import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.operators import boosting as b
from tidelake.operators.boosting import Booster, Params, Tree, fit, scored, shap_importance, shap_values

COLS = ["a", "b", "c", "d", "e", "f"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6)).round(2)
    x[:, 5] = rng.integers(0, 3, 700)
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] * (x[:, 5] > 0) + 0.3 * rng.normal(size=700))))
    y = (rng.random(700) < p).astype(int)
    rows = [("s", i, *map(float, x[i]), int(y[i]), i % 4 == 3) for i in range(700)]
    rows[5] = ("s", 5, None, float("nan"), *rows[5][4:])
    return spark.createDataFrame(rows, "sym string, t long, a double, b double, c double, d double, e double, f double, y int, val boolean").repartition(5).persist()


def arrays(df):
    rows = df.orderBy("t").toPandas()
    return np.nan_to_num(rows[COLS].to_numpy(float)), rows.y.to_numpy(), rows.val.to_numpy(bool)


def plain_booster(x, y, edges, p: Params):
    """No sampling: best leaf first by recursive search over rows, exact sums of rounded derivatives."""
    bins = np.stack([[sum(v > e for e in edges[k]) for v in x[:, k]] for k in range(x.shape[1])], axis=1)
    share = y.mean()
    margin = np.full(len(y), math.log(share / (1 - share)))
    shrink = lambda g: math.copysign(max(abs(g) - p.l1, 0), g)
    for _ in range(p.rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = np.rint((prob - y) * b.ONE) / b.ONE, np.rint(prob * (1 - prob) * b.ONE) / b.ONE
        worth = lambda rows: shrink(g[rows].sum()) ** 2 / (h[rows].sum() + p.l2)  # noqa: B023, E731

        def best(rows, g=g, h=h, worth=worth):
            found = None
            for k in range(x.shape[1]):
                for cut in range(len(edges[k])):
                    left, right = rows[bins[rows, k] <= cut], rows[bins[rows, k] > cut]
                    if min(len(left), len(right)) < p.least_rows or min(h[left].sum(), h[right].sum()) < p.least_weight or not len(left) or not len(right):
                        continue
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, left, right)
            return found

        leaves = [(np.arange(len(y)), 0)]
        open_ = [(best(leaves[0][0]), leaves[0])]
        while p.leaves is None or len(leaves) < p.leaves:
            can = [o for o in open_ if o[0] is not None]
            if not can:
                break
            top = max(can, key=lambda o: o[0][0])
            open_ = [o for o in open_ if o is not top]
            leaves = [x for x in leaves if x is not top[1]]
            for rows in top[0][1:]:
                leaf = (rows, top[1][1] + 1)
                leaves.append(leaf)
                open_.append((best(rows) if leaf[1] < p.depth else None, leaf))
        for rows, _ in leaves:
            margin[rows] += -shrink(g[rows].sum()) / (h[rows].sum() + p.l2) * p.rate
    return margin


@pytest.mark.parametrize("p", [Params(rounds=4, rate=0.3, depth=3, l1=0.2, l2=1.5, least_weight=3), Params(rounds=3, rate=0.3, depth=4, leaves=5, l1=0.5, least_rows=30, least_weight=1e-3)])
def test_equals_a_plain_booster(data, p):
    df = data.where("not val")
    model = fit(df, COLS, p)
    x, y, _ = arrays(df)
    assert np.allclose(model.margins(x), plain_booster(x, y, model.edges, p), atol=1e-9)
    if p.leaves:
        assert all(sum(c < 0 for c in t.column) <= p.leaves for t in model.trees)


def test_blocks_make_no_difference(data):
    p = Params(rounds=5, rate=0.3, depth=3, leaves=6, rows=0.7, columns=0.6, patience=3, l1=0.1)
    one = fit(data, COLS, p, valid="val")
    many = fit(data, COLS, p, valid="val", block_rows=100)
    assert one == many and one.trees and len(one.history) >= len(one.trees)
    assert Booster.from_json(one.to_json()) == one
    b.SNAPSHOT, before = 2, b.SNAPSHOT
    try:
        assert fit(data, COLS, p, valid="val", block_rows=100) == one
    finally:
        b.SNAPSHOT = before


def test_early_stopping_keeps_the_best(data):
    x, y, val = arrays(data)
    p = Params(rounds=60, rate=0.5, depth=4, patience=5)
    model = fit(data, COLS, p, valid="val")
    assert 0 < len(model.trees) < 60 and len(model.history) == min(60, len(model.trees) + 5)
    assert model.history.index(max(model.history)) + 1 == len(model.trees)
    m = model.margins(x)[val]
    pos, neg = m[y[val] == 1], m[y[val] == 0]
    exact = np.mean([[(a > c) + (a == c) / 2 for c in neg] for a in pos])
    assert abs(exact - model.history[len(model.trees) - 1]) < 2e-3 and exact > 0.7


def expected_given(tree: Tree, bins, known, node=0):
    """The tree's value for one row if only some columns are known: others go both ways by training rows."""
    c = tree.column[node]
    if c < 0:
        return tree.value[node]
    if c in known:
        return expected_given(tree, bins, known, tree.left[node] if bins[c] <= tree.cut[node] else tree.right[node])
    share = tree.rows[tree.left[node]] / tree.rows[node]
    return share * expected_given(tree, bins, known, tree.left[node]) + (1 - share) * expected_given(tree, bins, known, tree.right[node])


def test_attributions_are_shapley_values(spark, data):
    model = fit(data, COLS, Params(rounds=6, rate=0.4, depth=5, least_rows=3))
    some = data.where("t < 12")
    got = {r.t: r for r in shap_values(model, some).collect()}
    x, _, _ = arrays(some)
    bins = model.bins(x)
    for t in range(12):
        value = lambda known: sum(expected_given(tree, bins[t], known) for tree in model.trees)  # noqa: B023, E731
        for i in range(6):
            others = [k for k in range(6) if k != i]
            want = sum(math.factorial(n) * math.factorial(5 - n) / math.factorial(6) * (value({*s, i}) - value(set(s))) for n in range(6) for s in itertools.combinations(others, n))
            assert abs(got[t].shap[i] - want) < 1e-9
        assert abs(sum(got[t].shap) + model.expected() - got[t].margin) < 1e-9
    mean = shap_importance(model, data)
    every = shap_values(model, data).collect()
    assert all(abs(mean[c] - np.mean([abs(r.shap[k]) for r in every])) < 1e-9 for k, c in enumerate(COLS)) and mean["a"] > mean["c"]


def test_edges_of_the_table(spark, data):
    p = Params(rounds=2)
    none = fit(data.limit(0), COLS, p)
    assert none.trees == [] and {r.p for r in scored(none, data).select("p").collect()} == {0.5}
    flat = fit(data.withColumn("a", F.lit(1.0)), ["a"], p)
    assert len({r.p for r in scored(flat, data).select("p").collect()}) == 1
    one = fit(data.withColumn("y", F.lit(1)), COLS, replace(p, depth=2))
    assert all(r.p > 0.99 for r in scored(one, data).select("p").collect())
    assert scored(one, data.limit(0)).columns[-1] == "p"
