"""Feature importance, selection, models, calibration and walk-forward, on boosted trees of our own and ``pyspark.ml``."""

from __future__ import annotations

import random
import re
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.gram import correlation_matrix
from tidelake.functions.quantiles import exact_quantiles
from tidelake.functions.windows import flag
from tidelake.sources.store import checkpointed

from . import boosting
from .boosting import Booster, Params
from .rowops import Condition, Rule

AUC = "areaUnderROC"
#: Weights of the parts of an importance, and rows of a series that are held out for it.
WEIGHTS = {"shap": 0.4, "perm": 0.25, "mi": 0.2, "corr": 0.15}
HELD_OUT, LEAST_HELD_OUT, REPEATS = 500, 50, 10
#: The booster whose attributions count, and the forest whose accuracy is permuted.
EXPLAINED = Params(rounds=100, rate=0.1, depth=6)


def _clean(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) if c in columns else F.col(c) for c in df.columns])


def _stages(columns: list[str], scale: bool = False) -> list:
    filled = [f"{c}_f" for c in columns]
    out = [Imputer(inputCols=columns, outputCols=filled, strategy="mean"), VectorAssembler(inputCols=filled, outputCol="features_raw" if scale else "features", handleInvalid="keep")]
    return out + ([StandardScaler(inputCol="features_raw", outputCol="features", withMean=True)] if scale else [])


def forest(seed: int = 42, trees: int = 40, depth: int = 5) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)


#: The two boosted configurations; "linear" is a logistic regression.
BOOSTERS = {"boosted_a": boosting.DEPTH_FIRST, "boosted_b": boosting.LEAF_FIRST}
Model = Booster | PipelineModel


def variances(df: DataFrame, columns: list[str], least: float = 1e-3) -> list[str]:
    """Columns whose variance after scaling to 0..1 is above a least value; one pass."""
    row = df.agg(*[e for c in columns for e in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"), F.var_pop(c).alias(f"v_{c}"))]).first()
    return [c for c in columns if row[f"b_{c}"] is not None and (w := row[f"b_{c}"] - row[f"a_{c}"]) > 0 and row[f"v_{c}"] / w**2 > least]


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Pairwise Pearson correlations with pairwise nulls left out, from one job of blocked sums."""
    rho = correlation_matrix(df, columns)
    return {(a, b): float(rho[i, j]) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j and rho[i, j] == rho[i, j]}


def without_twins(df: DataFrame, columns: list[str], most: float = 0.85, protected: str | None = None) -> list[str]:
    """Columns left after dropping, of each pair that correlates too much, the later one (or the unprotected one)."""
    rho, gone = correlations(df, columns), set()
    keep = lambda c: bool(protected and re.search(protected, c))
    for (a, b), r in rho.items():
        if abs(r) > most and a not in gone and b not in gone:
            gone.add(a if keep(b) and not keep(a) else b)
    return [c for c in columns if c not in gone]


def mutual_information(df: DataFrame, columns: list[str], y: str = "y", bins: int = 10) -> DataFrame:
    """Mutual information of each column's quantile bins with the label, from counts."""
    cuts = exact_quantiles(df, columns, [k / bins for k in range(1, bins)])
    place = [F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), sum((flag(F.col(c) > e) for e in cuts[c] if e is not None), F.lit(0))).alias("bin")) for c in columns]
    counts = df.select(y, F.inline(F.array(*place))).where("bin is not null").groupBy("feature", "bin", y).agg(F.count("*").alias("n"))
    tot = counts.groupBy("feature").agg(F.sum("n").alias("t"))
    by_bin = counts.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_y = counts.groupBy("feature", y).agg(F.sum("n").alias("ny"))
    p = F.col("n") / F.col("t")
    return counts.join(tot, "feature").join(by_bin, ["feature", "bin"]).join(by_y, ["feature", y]).groupBy("feature").agg(F.sum(p * F.ln(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mi"))


def cleaned(df: DataFrame, columns: list[str], y: str = "y", most: float = 0.99) -> tuple[DataFrame, list[str]]:
    """Rows with a label, gaps filled from the row before, else from the row after, else by zero; infinities are zero. Constant columns go, and of twins the later.

    Filling is within a series, so the order of rows in it decides.
    """
    past = Window.partitionBy("sym").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("sym").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    d = _clean(df.where(F.col(y).isNotNull()), columns).withColumn("y", F.col(y).cast("double"))
    filled = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(ahead), F.lit(0.0))
    inside = lambda c: F.when(F.abs(filled(c)) < float("inf"), filled(c)).otherwise(0.0)
    d = checkpointed(d.select(*[inside(c).alias(c) if c in columns else F.col(c) for c in d.columns]))
    row = d.agg(*[F.stddev_samp(c).alias(str(k)) for k, c in enumerate(columns)]).first()
    live = [c for k, c in enumerate(columns) if (row[k] or 0.0) > 1e-8]
    rho = correlation_matrix(d, live)
    return d, [c for j, c in enumerate(live) if not any(abs(rho[i, j]) > most for i in range(j))]


def held_out(df: DataFrame) -> DataFrame:
    """``df`` with ``_test``: the last eighth of each series, HELD_OUT rows at most and LEAST_HELD_OUT at least."""
    n = F.count("*").over(Window.partitionBy("sym"))
    size = F.greatest(F.least(F.floor(n / 8), F.lit(HELD_OUT)), F.lit(LEAST_HELD_OUT))
    return df.withColumn("_test", F.row_number().over(Window.partitionBy("sym").orderBy(F.desc("t"))) <= size)


def permutation_drop(model: PipelineModel, test: DataFrame, columns: list[str], repeats: int = REPEATS, seed: int = 42) -> dict[str, float]:
    """Mean loss of accuracy when one column is taken from another row of its series: of ``repeats`` orders by hash, the next row in each.

    All columns and repeats are scored in one pass over the held-out rows.
    """
    turn = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r")
    rows = test.select("*", turn)
    order = Window.partitionBy("sym", "_r").orderBy(F.xxhash64("t", "_r", F.lit(seed)), "t")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.struct(*columns)
    rows = rows.withColumn("_o", F.coalesce(F.lead(other).over(order), F.first(other).over(whole)))
    tried = F.explode(F.array(F.struct(F.lit(-1).alias("k"), F.struct(*columns).alias("v")), *[F.struct(F.lit(k).alias("k"), F.struct(*[F.col(f"_o.{c}").alias(c) if c == d else F.col(d) for d in columns]).alias("v")) for k, c in enumerate(columns)]))
    wide = rows.select("y", tried.alias("x")).select("y", "x.k", "x.v.*")
    right = model.transform(wide).groupBy("k").agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("a")).collect()  # one row for each column
    got = {r.k: r.a for r in right}
    return {c: got[-1] - got[k] if -1 in got else 0.0 for k, c in enumerate(columns)}


def importance(df: DataFrame, columns: list[str], y: str = "y") -> DataFrame:
    """Attributions of a booster and permutation of a forest (both fitted before the held-out rows and measured on them), mutual information and correlation, each scaled to 0..1, combined by WEIGHTS and ranked.

    Columns are ``cleaned`` first: what goes there is not ranked. ``df`` has sym and t.
    """
    d, live = cleaned(df, columns, y)
    d = checkpointed(held_out(d))
    fit, test = d.where("not _test"), d.where("_test")
    rho = dict(zip(live, correlation_matrix(d, [*live, "y"])[-1], strict=False))
    shap = boosting.shap_importance(boosting.fit(fit, live, EXPLAINED), test)
    model = Pipeline(stages=[VectorAssembler(inputCols=live, outputCol="features"), forest(trees=100, depth=10)]).fit(fit)
    drop = permutation_drop(model, test, live)
    rows = [(c, 0.0 if rho[c] != rho[c] else abs(float(rho[c])), drop[c], shap[c]) for c in live]
    scores = df.sparkSession.createDataFrame(rows, "feature string, corr double, perm double, shap double").join(mutual_information(d, live), "feature", "left")
    every = Window.partitionBy()  # one row for each column
    norm = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(every), F.max(c).over(every) - F.min(c).over(every)), F.lit(0.0))
    out = scores.select("feature", "corr", "mi", "perm", "shap", sum((norm(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature")))


def by_category(scores: DataFrame, category) -> DataFrame:
    """Share of each category: mean of 1 / (rank + 1), normalised."""
    c = scores.withColumn("category", category).groupBy("category").agg(F.avg(1 / (F.col("rank") + 1)).alias("w"))
    return c.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy()))


def select(df: DataFrame, columns: list[str], y: str = "y", blacklist: str | None = None, protected: str | None = None, priority: dict[str, float] | None = None, top: int = 50) -> list[str]:
    """Blacklist, variance, twins, then 0.4 mutual information + 0.4 forest + 0.2 priority; the best ``top``."""
    cols = [c for c in columns if not (blacklist and re.search(blacklist, c))]
    d = _clean(df.where(F.col(y).isNotNull()), cols).withColumn("y", F.col(y).cast("double"))
    cols = without_twins(d, variances(d, cols), protected=protected)
    model = Pipeline(stages=[*_stages(cols), forest()]).fit(d)
    rf = dict(zip(cols, model.stages[-1].featureImportances.toArray().tolist(), strict=True))
    mi = {r.feature: r.mi for r in mutual_information(d, cols).collect()}  # one row for each column
    top_mi, top_rf = max([*mi.values(), 1e-12]), max([*rf.values(), 1e-12])
    score = {c: 0.4 * mi.get(c, 0) / top_mi + 0.4 * rf[c] / top_rf + 0.2 * (priority or {}).get(c, 0) for c in cols}
    return sorted(cols, key=lambda c: (-score[c], c))[:top]


def train(df: DataFrame, columns: list[str], names: tuple[str, ...] = ("boosted_a", "boosted_b"), valid: str | None = None, rounds: int | None = None) -> dict[str, Model]:
    """A model of each name; boosters stop early by the rows where ``valid`` is true, which no model learns from. ``rounds``: trees at most."""
    out: dict[str, Model] = {}
    for n in names:
        if n in BOOSTERS:
            p = BOOSTERS[n]
            out[n] = boosting.fit(df, columns, p if rounds is None else replace(p, rounds=min(p.rounds, rounds)), valid=valid)
        else:
            d = _clean(df.where(~F.coalesce(F.col(valid), F.lit(False))) if valid else df, columns)
            out[n] = Pipeline(stages=[*_stages(columns, scale=True), LogisticRegression(labelCol="y", regParam=0.01)]).fit(d)
    return out


def probabilities(models: dict[str, Model], weights: dict[str, float], df: DataFrame, columns: list[str]) -> DataFrame:
    """The weighted mean probability of several models, column ``p``."""
    out = _clean(df, columns)
    for n, m in models.items():
        if isinstance(m, Booster):
            out = boosting.scored(m, out, f"p_{n}")
        else:
            out = m.transform(out).select(*out.columns, vector_to_array("probability")[1].alias(f"p_{n}"))
    total = sum(weights.values())
    p = sum((F.col(f"p_{n}") * w for n, w in weights.items()), F.lit(0.0)) / total
    return out.withColumn("p", p)


def auc(df: DataFrame, p: str = "p") -> float:
    return BinaryClassificationEvaluator(labelCol="y", rawPredictionCol=p, metricName=AUC).evaluate(df.withColumn("y", F.col("y").cast("double")))


def ensemble_weight(auc: float) -> float:
    return max(0.01, (auc - 0.5) * 10)


def ensemble(train_df: DataFrame, val_df: DataFrame, columns: list[str], names=("boosted_a", "boosted_b"), rounds: int | None = None):
    """Models that stop early by the validation part, and their weights max(.01, (auc - .5) * 10) from it."""
    both = train_df.withColumn("_valid", F.lit(False)).unionByName(val_df.withColumn("_valid", F.lit(True)))
    models = train(both, columns, names, valid="_valid", rounds=rounds)
    weights = {n: ensemble_weight(auc(probabilities({n: m}, {n: 1.0}, val_df, columns))) for n, m in models.items()}
    return models, weights


def anchored(df: DataFrame, columns: list[str]):
    """0.7 linear and 0.3 boosted; signals at .55 and .45."""
    models = train(df, columns, ("linear", "boosted_a"))
    return lambda d: probabilities(models, {"linear": 0.7, "boosted_a": 0.3}, d, columns).withColumn("sig", F.when(F.col("p") > 0.55, 1).when(F.col("p") < 0.45, -1).otherwise(0))


def platt(df: DataFrame, p: str = "p"):
    """A logistic curve from probabilities to calibrated ones."""
    model = Pipeline(stages=[VectorAssembler(inputCols=[p], outputCol="_p"), LogisticRegression(labelCol="y", featuresCol="_p", rawPredictionCol="_r", probabilityCol="_c", predictionCol="_d")]).fit(df.select(p, F.col("y").cast("double").alias("y")))
    return lambda d: model.transform(d).withColumn("calibrated", vector_to_array("_c")[1]).drop("_p", "_r", "_c", "_d")


def walk_forward(df: DataFrame, columns: list[str], train_rows: int, test_rows: int, purge: int = 12, names=("boosted_a",), rounds: int = 60) -> DataFrame:
    """One model per fold (``rounds`` trees at most), fitted before it and scored after a purged gap; as many folds as the longest series has."""
    from .backtest import S, apply

    df, i = checkpointed(apply(df, {"i": S.row() - 1})), F.col("i")
    n = df.agg(F.coalesce(F.max("i") + 1, F.lit(0))).first()[0]
    out = []
    for k in range(max(0, -((train_rows + purge - n) // test_rows))):
        start = train_rows + k * test_rows
        a, b = df.where(i < start), df.where((i >= start + purge) & (i < start + purge + test_rows))
        if a.select("y").distinct().count() < 2 or b.isEmpty():
            continue
        models = train(a, columns, names, rounds=rounds)
        out.append((k, auc(probabilities(models, dict.fromkeys(names, 1.0), b, columns))))
    return df.sparkSession.createDataFrame(out, "fold int, auc double")


def all_tree_rules(df: DataFrame, columns: list[str], depths=range(2, 6), least: int = 20, confidence: float = 0.0) -> list[Rule]:
    """Rules of trees of several depths that are confident enough, most confident first; of equal conditions one."""
    d = checkpointed(_clean(df.where("y is not null"), columns))
    found: dict[frozenset, Rule] = {}
    for depth in depths:
        for r in tree_rules(d, columns, depth, least):
            if r.stats["confidence"] >= confidence:
                found.setdefault(frozenset(r.conditions), replace(r, name=f"depth{depth}_{r.name}"))
    return sorted(found.values(), key=lambda r: (-r.stats["confidence"], -r.stats["support"], r.name))


def tree_rules(df: DataFrame, columns: list[str], depth: int = 3, least: int = 20) -> list[Rule]:
    """Paths of a decision tree to leaves as rules with support and confidence."""
    d = _clean(df.where("y is not null"), columns).withColumn("y", F.col("y").cast("double"))
    model = Pipeline(stages=[*_stages(columns), DecisionTreeClassifier(labelCol="y", maxDepth=depth, minInstancesPerNode=least)]).fit(d)
    out: list[Rule] = []

    def walk(node, path):
        if node.numDescendants() == 0:
            stats = list(node.impurityStats().stats())
            win = stats[1] / max(sum(stats), 1e-12)
            out.append(Rule(f"tree_{len(out)}", tuple(path), direction="LONG" if win >= 0.5 else "SHORT", stats={"support": sum(stats), "confidence": max(win, 1 - win)}))
            return
        s = node.split()
        f, t = columns[s.featureIndex()], s.threshold()
        walk(node.leftChild(), [*path, Condition(f, "<=", t)])
        walk(node.rightChild(), [*path, Condition(f, ">", t)])

    walk(model.stages[-1]._call_java("rootNode"), [])
    return [r for r in out if r.conditions]


def clusters(df: DataFrame, columns: list[str], ks=range(2, 7)) -> tuple[int, dict[str, int]]:
    """Groups of features: k-means over their correlations with one another, k by silhouette."""
    rho = correlations(df, columns)
    get = lambda a, b: 1.0 if a == b else rho.get((a, b), rho.get((b, a), 0.0))
    rows = df.sparkSession.createDataFrame([(a, *[get(a, b) for b in columns]) for a in columns], ["feature", *[f"c{i}" for i in range(len(columns))]])
    v = VectorAssembler(inputCols=rows.columns[1:], outputCol="features").transform(rows)
    best = None
    for k in ks:
        if k >= len(columns):
            break
        fit = KMeans(k=k, seed=42).fit(v).transform(v)
        if fit.select("prediction").distinct().count() < 2:
            continue
        s = ClusteringEvaluator().evaluate(fit)
        if best is None or s > best[0]:
            best = (s, k, fit)
    return (0, {}) if best is None else (best[1], {r.feature: r.prediction for r in best[2].select("feature", "prediction").collect()})


def simplex(weights: dict[str, float]) -> dict[str, float]:
    total = sum(max(0.0, w) for w in weights.values()) or 1.0
    return {k: max(0.0, w) / total for k, w in weights.items()}


def genetic(df: DataFrame, columns: list[str], ret: str = "ret", size: int = 50, rounds: int = 20, seed: int = 42, most: int = 5, min_trades: int = 20, holding: int = 6) -> list[tuple[Rule, float]]:
    """Rules of 2 to ``most`` conditions bred by two-point crossover, mutation and tournaments, with their Sharpe.

    Trades don't overlap; a rule with fewer than ``min_trades`` is not fit.
    Rules not met before are scored in one job per generation, on the bars on
    which they fire. Returned are the fit rules of the last generation, best first.
    """
    from .search import S, spaced

    rng = random.Random(seed)
    pcts = [k / 100 for k in range(10, 91)]
    known = df.where(F.col(ret).isNotNull())
    cut = exact_quantiles(known, columns, pcts)
    base = known.select("sym", "t", ret, *columns, (S.row() - 1).cast("double").alias("i")).persist()
    days = max(1.0, base.count() / 6)
    gene = lambda: (rng.choice(columns), rng.choice("<>"), rng.randrange(81))
    rule = lambda g: Rule("&".join(f"{c}{o}{k + 10}" for c, o, k in g), tuple(Condition(c, o, cut[c][k]) for c, o, k in g if cut[c][k] is not None))
    seen: dict[tuple, float] = {}

    def score(pop):
        new = sorted(set(pop) - seen.keys())
        if new:
            hits = F.array_compact(F.array(*[F.when(rule(g).column(base.columns), F.lit(k)) for k, g in enumerate(new)]))
            kept = spaced(base.select("sym", "t", "i", ret, F.explode(hits).alias("k")), ["k", "sym"], holding)
            got = {r.k: r for r in kept.groupBy("k").agg(F.count("*").alias("n"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s")).collect()}  # one row for each rule
            for k, g in enumerate(new):
                r = got.get(k)
                seen[g] = r.m / (r.s + 1e-8) * (r.n / days * 365) ** 0.5 if r and r.n >= max(10, min_trades) else float("-inf")
        return [seen[g] for g in pop]

    def crossed(a, b):
        i, j = sorted(rng.sample(range(min(len(a), len(b)) + 1), 2))
        return a[:i] + b[i:j] + a[j:], b[:i] + a[i:j] + b[j:]

    pop = [tuple(gene() for _ in range(rng.randint(2, most))) for _ in range(size)]
    for _ in range(rounds):
        young = list(pop)
        for k in range(1, size, 2):
            if rng.random() < 0.5:
                young[k - 1], young[k] = crossed(young[k - 1], young[k])
        for k, g in enumerate(young):
            if rng.random() < 0.3:
                at = rng.randrange(len(g))
                young[k] = (*g[:at], gene(), *g[at + 1 :])
        fit = dict(zip(young, score(young), strict=True))
        pop = [max(rng.choices(young, k=3), key=fit.__getitem__) for _ in range(size)]
    base.unpersist()
    best = sorted({g for g in pop if seen[g] > 0}, key=lambda g: (-seen[g], g))
    return [(rule(g), seen[g]) for g in best]


def loss_rules(df: DataFrame, columns: list[str], ret: str = "ret", least: int = 50, loss_rate: float = 0.6) -> list[Rule]:
    """Leaves of trees of depth 2 to 4 that predict losses, as rules for ``search.loss_patterns``."""
    marked = df.where(F.col(ret).isNotNull()).withColumn("y", (F.col(ret) < 0).cast("double"))
    out = []
    for depth in (2, 3, 4):
        for r in tree_rules(marked, columns, depth, max(least // 2, 20)):
            lost = r.stats["confidence"] if r.direction == "LONG" else 1 - r.stats["confidence"]
            if lost >= loss_rate and r.stats["support"] >= least // 2:
                out.append(Rule(f"loss_cluster_{len(out)}", r.conditions))
    return out
