"""Learning as queries. SQL can't express these; tests hold them to structure and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions.sqlkit import BARS, lag, lead
from tidelake.operators import backtest as bt
from tidelake.operators import boosting as bo
from tidelake.operators import features as ft
from tidelake.operators import learning as ln
from tidelake.operators import search as sc
from tidelake.operators import structure as sr
from tidelake.operators import training as tr
from tidelake.sources.store import shared_folder

from .base import Registry, bars4h

R = Registry()
COLS = ["price_return_1h", "price_return_3h", "price_return_6h", "price_zscore_24h", "v", "taker_buy_ratio"]


def learning_frame(s, d):
    """Bars with a few features, the return over six bars and whether it rises."""
    b = ft.apply(bars4h(s, d), *ft.returns((1, 3, 6)), *ft.zscores(ks=(24,)), *ft.taker()[:1])
    b = ft.apply(b, {"ret": (F.try_divide(ft.S.lead("c", 6), F.col("c")) - 1) / 1000})
    return b.withColumn("y", (F.col("ret") > 0).cast("double")).where("ret is not null")


def _parts(s, d):
    x = bt.split(learning_frame(s, d))
    return {k: x.where(F.col("split") == k) for k in ("train", "val", "test")}


@R.add("l01_importance", None)
def _(s, d):
    return ln.importance(learning_frame(s, d), COLS)


@R.add("l01_attributions", None)
def _(s, d):
    """Shapley values of every held-out row, with the margin that they add up to."""
    b, live = ln.cleaned(learning_frame(s, d), COLS)
    b = ln.held_out(b)
    model = bo.fit(b.where("not _test"), live, ln.EXPLAINED)
    x = bo.shap_values(model, b.where("_test"))
    total = F.aggregate("shap", F.lit(float(model.expected())), lambda a, v: a + v)
    return x.select("sym", "t", F.posexplode("shap").alias("k", "attribution"), "margin", total.alias("total")).withColumn("feature", F.element_at(F.array(*map(F.lit, live)), F.col("k") + 1)).drop("k")


@R.add("l03_category_importance", None)
def _(s, d):
    return ln.by_category(ln.importance(learning_frame(s, d), COLS), F.when(F.col("feature").startswith("price"), "price").otherwise("flow"))


@R.add("l05_selected", None)
def _(s, d):
    return s.createDataFrame([(i, c) for i, c in enumerate(ln.select(learning_frame(s, d), COLS, blacklist="return_1h", top=4))], "rank int, feature string")


@R.add("l07_ensemble", None)
def _(s, d):
    p = _parts(s, d)
    models, w = ln.ensemble(p["train"], p["val"], COLS)
    return ln.probabilities(models, w, p["test"], COLS).select("sym", "t", "p")


@R.add("l08_anchored", None)
def _(s, d):
    p = _parts(s, d)
    return ln.anchored(p["train"], COLS)(p["test"]).select("sym", "t", "p", "sig")


@R.add("l09_platt", None)
def _(s, d):
    p = _parts(s, d)
    models = ln.train(p["train"], COLS, ("boosted_a",))
    score = lambda x: ln.probabilities(models, {"boosted_a": 1.0}, x, COLS)
    return ln.platt(score(p["val"]))(score(p["test"])).select("sym", "t", "p", "calibrated")


@R.add("l10_walk_forward", None)
def _(s, d):
    return ln.walk_forward(learning_frame(s, d), COLS, 60, 30)


@R.add("l11_train", None)
def _(s, d):
    """A training run, saved, loaded and used: the calibrated score of every bar, with what the report says of the run."""
    b = learning_frame(s, d)
    model, scores, report = tr.train(b, COLS, ret="ret", train_rows=60, test_rows=30, rounds=100)
    folder = shared_folder(s, "model")
    tr.save(s, folder, model, scores, report)
    model, _, report = tr.load(s, folder)
    out = model.transform(b).select("sym", "t", "p", "calibrated")
    return out.withColumn("test_auc", F.lit(report["test"]["auc"])).withColumn("folds", F.lit(len(report["folds"])))


@R.add("l11_scores", None)
def _(s, d):
    """The columns that a training run selects, and the splits that its boosters make on each."""
    return tr.train(learning_frame(s, d), COLS, ret="ret", train_rows=60, test_rows=30, rounds=100)[1]


def _roles(s, d):
    """The learning frame under names that thresholds and groupings look for."""
    b = learning_frame(s, d)
    return ft.apply(b, {"rsi_14": F.col("c"), "oi_change_1h": ft.S.pct_change("n"), "fear_greed_value": F.col("o"), "funding_zscore": F.col("price_zscore_24h"), "taker_ratio": F.col("taker_buy_ratio"), "momentum_3": F.col("price_return_3h"), "vix_level": F.col("v"), "liq_sum": F.col("tb")})


ROLES = ["rsi_14", "oi_change_1h", "fear_greed_value", "funding_zscore", "taker_ratio", "momentum_3", "vix_level", "liq_sum"]


@R.add("l12_optimised_weights", None)
def _(s, d):
    x = _roles(s, d)
    groups, start = sr.grouped(ROLES, sr.STRUCTURES["5 pillars"][0]), sr.STRUCTURES["5 pillars"][1]
    w = sr.best_weights(x, ROLES, groups, start)
    return s.createDataFrame([(k, v, w["baseline"], w["score"]) for k, v in w["weights"].items()], "pillar string, weight double, baseline double, score double")


@R.add("l12_evolved_thresholds", None)
def _(s, d):
    t = sr.best_thresholds(_roles(s, d), ROLES, method="evolution")
    return s.createDataFrame([(k, v, t["baseline"], t["score"]) for k, v in t["thresholds"].items()], "threshold string, value double, baseline double, score double")


@R.add("l12_optimised_thresholds", None)
def _(s, d):
    t = sr.best_thresholds(_roles(s, d), ROLES)
    return s.createDataFrame([(k, v, t["baseline"], t["score"]) for k, v in t["thresholds"].items()], "threshold string, value double, baseline double, score double")


_SIGNAL = "least(greatest(0.3 * (coalesce((c < 30)::int, 0) - coalesce((c > 70)::int, 0)) + 0.3 * (coalesce((oi > 0.05)::int, 0) - coalesce((oi < -0.05)::int, 0)) + 0.2 * (coalesce((o < 20)::int, 0) - coalesce((o > 80)::int, 0)), -1), 1)"
_OBJECTIVE = f"""with {BARS}, n as (select *, n / nullif({lag('n')}, 0) - 1 as oi, ({lead('c', 6)} / nullif(c, 0) - 1) / 1000 as ret from bars), x as (select {_SIGNAL} as s, ret from n where ret is not null),
g as (select count(*) as bars, count(*) filter (where abs(s) > 0.1) as k, avg(s * ret) filter (where abs(s) > 0.1) as m, stddev_samp(s * ret) filter (where abs(s) > 0.1) as sd, avg((s * ret > 0)::int) as w, corr(s, ret) as c from x)
select round(0.5 * least(greatest(m / sd * sqrt(k / (bars / 6.0) * 365) / 3, -1), 1) + 0.3 * (w - 0.5) * 2 + 0.2 * c, 6) as score from g"""


@R.add("l12_objective", _OBJECTIVE)
def _(s, d):
    """The score of the present thresholds."""
    x = ft.apply(bars4h(s, d), {"rsi_14": F.col("c"), "oi_change_1h": ft.S.pct_change("n"), "fear_greed_value": F.col("o"), "ret": (F.try_divide(ft.S.lead("c", 6), F.col("c")) - 1) / 1000})
    score = sr.objectives(x, [sr.threshold_signal(x.columns, {k: v[0] for k, v in sr.THRESHOLDS.items()})])[0]
    return s.createDataFrame([(round(score, 6),)], "score double")


# Categories by the beginnings of feature names.
CATEGORIES = {"derivatives": ("oi_", "funding_"), "price": ("rsi_", "momentum_"), "liquidation": ("liq_",), "sentiment": ("fear_",), "macro": ("vix_",)}


@R.add("l04_pillars", None)
def _(s, d):
    """The assumed pillars against what the importances of the columns say."""
    name = F.lit("other")
    for c, begin in CATEGORIES.items():
        name = F.when(F.greatest(*[F.startswith("feature", F.lit(b)).cast("int") for b in (*begin, begin[0])]) > 0, c).otherwise(name)
    shares = ln.by_category(ln.importance(_roles(s, d), ROLES), name)
    return sr.validated_pillars(shares.select("category", "share"))


@R.add("l14_structures", None)
def _(s, d):
    found = sr.structures(_roles(s, d), ROLES)
    return s.createDataFrame([(i, n, float(x)) for i, (n, _, _, x) in enumerate(found)], "rank int, structure string, score double")


@R.add("l15_full_optimisation", None)
def _(s, d):
    found = sr.full_optimisation(_roles(s, d), ROLES)
    rows = [("thresholds", found["thresholds"]["baseline"], found["thresholds"]["score"]), ("weights", found["weights"]["baseline"], found["weights"]["score"])]
    return s.createDataFrame(rows, "what string, baseline double, score double")


@R.add("l14_feature_clusters", None)
def _(s, d):
    k, groups = ln.clusters(learning_frame(s, d), COLS)
    return s.createDataFrame([(k, f, g) for f, g in groups.items()], "k int, feature string, cluster int")


@R.add("r11_tree_rules", None)
def _(s, d):
    rules = ln.all_tree_rules(learning_frame(s, d), COLS)
    return s.createDataFrame([(r.name, r.direction, r.stats["support"], r.stats["confidence"], [(c.feature, c.operator, float(c.threshold)) for c in r.conditions]) for r in rules], "rule string, direction string, support double, confidence double, conditions array<struct<feature:string,operator:string,threshold:double>>")


@R.add("r12_genetic_rules", None)
def _(s, d):
    return s.createDataFrame([(i, r.name, float(x)) for i, (r, x) in enumerate(ln.genetic(learning_frame(s, d), COLS))], "rank int, rule string, sharpe double")


@R.add("r19_loss_clusters", None)
def _(s, d):
    x = learning_frame(s, d)
    return sc.loss_patterns(x, COLS, rules=ln.loss_rules(x, COLS, least=20, loss_rate=0.55), min_n=20, loss_rate=0.55)
