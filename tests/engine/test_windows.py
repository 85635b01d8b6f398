"""The window kit against pandas, with gaps, constant series, ties and two series interleaved."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelake.functions import scan as sc
from tidelake.functions import stats
from tidelake.functions.windows import Series
from tidelake.operators import bars as B
from tidelake.operators.rowops import Condition, Rule

S = Series("sym", "t")


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"sym": np.where(np.arange(160) % 2, "a", "b"), "t": np.arange(160), "x": rng.normal(10, 2, 160).round(1)})
    pdf.loc[pdf.index[[0, 1, 2, 9, 40, 41, 90]], "x"] = np.nan
    pdf.loc[100:130, "x"] = 5.0
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    return pdf, df


def same(df, pdf, cols):
    got = df.select("sym", "t", *cols).toPandas().sort_values("t")
    for c, want in cols_of(pdf, cols).items():
        assert np.allclose(got[c].astype(float), want.sort_index().astype(float), atol=1e-8, equal_nan=True), c


def cols_of(pdf, cols):
    g = pdf.groupby("sym")["x"]
    each = {
        "mean5": lambda x: x.rolling(5).mean(),
        "std5": lambda x: x.rolling(5).std(),
        "min_p": lambda x: x.rolling(8, min_periods=3).max(),
        "q": lambda x: x.rolling(10).quantile(0.95),
        "rank": lambda x: x.rolling(10, min_periods=3).rank(pct=True),
        "ffill": lambda x: x.ffill(limit=2),
        "diff": lambda x: x.diff(3),
        "adj": lambda x: x.ewm(span=7, adjust=True).mean(),
        "rec": lambda x: x.ewm(alpha=0.2, adjust=False).mean(),
        "expand": lambda x: x.expanding(min_periods=4).quantile(0.9),
    }
    return {c: g.transform(each[c]) for c in cols}


def test_rolling_like_pandas(frame):
    pdf, df = frame
    cols = {"mean5": S.mean("x", 5), "std5": S.std("x", 5), "min_p": S.roll(F.max, "x", 8, 3), "q": S.quantile("x", 10, 0.95), "rank": S.rank_pct("x", 10, 3), "ffill": S.ffill("x", 2), "diff": S.diff("x", 3), "expand": S.expand(lambda c: F.percentile(c, 0.9), "x", 4)}
    same(df.select("sym", "t", *[e.alias(n) for n, e in cols.items()]), pdf, list(cols))


def test_recursive_means_like_pandas(frame, spark):
    pdf, df = frame
    out = sc.ema(sc.ema(df, "x", "adj", span=7, order=("t",)), "x", "rec", alpha=0.2, adjust=False, order=("t",))
    same(out, pdf, ["adj", "rec"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # states cross batches
    same(sc.ema(df, "x", "adj", span=7, order=("t",)), pdf, ["adj"])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_greedy_mask(spark):
    sig = [0, 1, 1, 0, 0, 0, 1, 1, 1, 0, 0, 0, 0, 1]
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(sig)], "sym string, t long, s double")
    got = [r.t for r in sc.non_overlapping(df, "s", "keep", 6, order=("t",)).where("keep = 1").collect()]
    assert sorted(got) == [1, 7, 13]


def test_asof_keeps_rows_whole(spark):
    left = spark.createDataFrame([("a", t) for t in (96, 100, 104)], "sym string, t long").withColumn("p", F.col("t") * 1.0)
    right = spark.createDataFrame([("a", 90, 2.0), ("a", 98, None), ("a", 103, 3.0), ("b", 99, 9.0)], "sym string, t long, x double")
    assert [(r.t, r.x) for r in B.asof(left, right, ["sym"]).orderBy("t").collect()] == [(96, 2.0), (100, None), (104, 3.0)]
    assert B.asof(left, right.limit(0), ["sym"]).where("x is not null").count() == 0


def test_rules(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    keep = lambda *c, **k: [r.x for r in df.where(Rule("r", c, **k).column(df.columns)).collect()]
    assert keep(Condition("x", ">", 2.0)) == [3.0] and keep(Condition("y", ">", 2.0)) == [] and keep(Condition("x", "between", (1.0, 2.0))) == [1.0]
    assert keep(Condition("x", "==", 1.0), Condition("x", ">", 2.0), logic="OR") == [1.0, 3.0] and keep() == []


def test_distributions():
    assert abs(2 * stats.t_sf(2.228, 10) - 0.05) < 1e-4 and abs(stats.t_sf(0, 5) - 0.5) < 1e-12
    assert abs(stats.binomial_sf(7, 10) - 0.171875) < 1e-9 and stats.binomial_sf(0, 10) == 1 and stats.binomial_sf(11, 10) == 0
    assert abs(stats.chi2_1_sf(3.841459) - 0.05) < 1e-6 and abs(stats.normal_sf(1.959964) - 0.025) < 1e-6


def test_exact_quantiles(spark):
    import numpy as np
    import pandas as pd
    from tidelake.functions.quantiles import exact_quantiles

    rng = np.random.default_rng(0)
    p = pd.DataFrame({"a": rng.normal(size=30_000), "b": rng.integers(0, 3, 30_000).astype(float), "e": np.nan})
    p.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "a double, b double, e double").repartition(5)
    qs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = exact_quantiles(df, ["a", "b", "e"], qs)
    assert np.allclose(got["a"], p.a.quantile(qs)) and np.allclose(got["b"], p.b.quantile(qs)) and got["e"] == [None] * 5
    assert exact_quantiles(spark.createDataFrame([(1.0,), (4.0,)], "b double"), ["b"], [0.5])["b"] == [2.5]


def test_expanding_quantile(spark):
    import numpy as np
    import pandas as pd
    from tidelake.functions.quantiles import Ordered, expanding_quantile

    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 5000).astype(float)
    o = Ordered()
    for i, v in enumerate(x):
        o.add(v)
        if i % 500 == 0:
            assert np.isclose(o.quantile(0.9), np.quantile(x[: i + 1], 0.9))
    p = pd.DataFrame({"sym": "a", "t": range(300), "x": x[:300]})
    got = [r.q for r in expanding_quantile(spark.createDataFrame(p), "x", "q", 0.9, 10).orderBy("t").collect()]
    want = p.x.expanding(10).quantile(0.9)
    assert got[:9] == [None] * 9 and np.allclose(got[9:], want[9:])


def test_stretches_are_as_the_whole(spark):
    """Cuts of any size, gaps and crowded days leave windows as they are."""
    import numpy as np
    import pandas as pd
    from tidelake.operators import bars as B
    from tidelake.operators import features as ft

    rng = np.random.default_rng(2)
    rows = []
    for sym in "ab":
        t = np.sort(np.concatenate([rng.choice(4000, 300, replace=False), 10_000 + np.arange(150), 20_000 + rng.choice(9000, 200, replace=False)]))
        rows.append(pd.DataFrame({"sym": sym, "t": t, "c": rng.normal(size=len(t)) + 5}))
    df = spark.createDataFrame(pd.concat(rows))
    build = lambda x: ft.apply(x, *ft.zscores(ks=(24,)), {"up": ft.S.lead("c", 5), "old": ft.S.lag("c", 24)})
    want = sorted(map(repr, build(df).select("sym", "t", "price_zscore_24h", "up", "old").collect()))
    for size, seconds in ((10, 100), (60, 500), (100_000, 100)):
        got = B.in_stretches(df, build, 25, 5, rows=size, seconds=seconds)
        assert sorted(map(repr, got.select("sym", "t", "price_zscore_24h", "up", "old").collect())) == want
    assert B.in_stretches(df, build, 25, 5, rows=60, seconds=500).columns == build(df).columns
