"""Second-order boosted trees for 0/1 labels, and the Shapley values of their margins.

Values are binned by quantiles of each column and rows are packed into blocks
of bins. A tree grows level by level: each block adds up first and second
derivatives by node, column and bin; sums of one node and column meet in one
task, which returns the best cut, so the driver sees a row a node and column
and never the data. All nodes down to the depth limit are measured; then the
best ones are kept first, up to the number of leaves, which gives the same
tree as splitting the best leaf first, since a node's gain depends on its own
rows only.

Derivatives are rounded to 2^-20, so sums are whole numbers: given the edges of
the bins, a model does not depend on how the rows are dealt or on repeated
tasks. Rows that fit in one block are boosted in one task by the same code, with
the same result.
"""

from __future__ import annotations

import heapq
import json
import math
import random
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidelake.functions.package import send
from tidelake.sources.store import checkpointed

#: One in derivatives' whole numbers; bins of a column; bins of probabilities by which the AUC is counted.
ONE, BINS, AUC_BINS = 1 << 20, 256, 1 << 14
#: Rows of a block, and trees after which margins are written anew.
BLOCK_ROWS, SNAPSHOT = 32_768, 16


@dataclass(frozen=True)
class Params:
    """``patience``: rounds without a better AUC on the validation part after which boosting stops (0: never)."""

    rounds: int = 100
    rate: float = 0.05
    depth: int = 4
    leaves: int | None = None
    l1: float = 0.0
    l2: float = 1.0
    least_weight: float = 1.0
    least_rows: int = 1
    rows: float = 1.0
    columns: float = 1.0
    patience: int = 0
    seed: int = 42


# The two configurations of the ensemble.
DEPTH_FIRST = Params(rounds=500, rate=0.05, depth=4, l1=0.1, l2=1.0, least_weight=10, rows=0.8, columns=0.8, patience=50)
LEAF_FIRST = Params(rounds=1000, rate=0.03, depth=4, leaves=15, l1=0.5, l2=1.0, least_weight=1e-3, least_rows=30, rows=0.7, columns=0.7, patience=100)


@dataclass
class Tree:
    """Nodes as arrays: column (-1: a leaf), cut (rows with a bin up to it go left), children, value, rows."""

    column: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def add(self, value: float, rows: int) -> int:
        for x, v in ((self.column, -1), (self.cut, -1), (self.left, -1), (self.right, -1), (self.value, value), (self.rows, rows)):
            x.append(v)
        return len(self.column) - 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        column, cut, left, right = (np.array(x, np.int64) for x in (self.column, self.cut, self.left, self.right))
        live = np.flatnonzero(column[at] >= 0)
        while len(live):
            a = at[live]
            at[live] = np.where(bins[live, column[a]] <= cut[a], left[a], right[a])
            live = live[column[at[live]] >= 0]
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Booster:
    """A fitted model: columns, their bin edges, the margin that all rows start from, trees, and AUCs on the validation part."""

    columns: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]
    params: Params
    history: list[float] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bins of raw values (rows by columns); a missing value counts as zero."""
        return binned(values, self.edges)

    def margins(self, values: np.ndarray) -> np.ndarray:
        b = self.bins(values)
        return self.base + sum((t.margins(b) for t in self.trees), np.zeros(len(b)))

    def attributions(self, values: np.ndarray) -> np.ndarray:
        """Shapley values of the margin (rows by columns); with ``expected`` they sum to it."""
        b = self.bins(values)
        out = np.zeros((len(b), len(self.columns)))
        for t in self.trees:
            _attribute(t, b, out)
        return out

    def expected(self) -> float:
        """The mean margin by the rows of the leaves."""
        total = self.base
        for t in self.trees:
            leaves = [i for i, c in enumerate(t.column) if c < 0]
            total += sum(t.value[i] * t.rows[i] for i in leaves) / max(1, t.rows[0])
        return total

    def gains_by_column(self) -> dict[str, int]:
        """Number of splits on each column."""
        used = [c for t in self.trees for c in t.column if c >= 0]
        return {c: used.count(i) for i, c in enumerate(self.columns)}

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Booster:
        d = json.loads(text)
        return Booster(d["columns"], d["edges"], d["base"], [Tree(**t) for t in d["trees"]], Params(**d["params"]), d["history"])


def binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    v = np.nan_to_num(values, nan=0.0, posinf=np.inf, neginf=-np.inf)
    return np.stack([np.searchsorted(e, v[:, k]) for k, e in enumerate(edges)], axis=1).astype(np.uint8) if edges else np.zeros((len(v), 0), np.uint8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Shares in 0..1 of 64-bit row hashes, other ones for each salt."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return (x ^ (x >> np.uint64(33))).astype(np.float64) / 2.0**64


def derivatives(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(margin)
    return np.rint((p - y) * ONE), np.rint(p * (1 - p) * ONE)


def level_sums(bins, node, g, h, n_nodes: int, columns: list[int]) -> np.ndarray:
    """Sums of both derivatives and rows by node, column and bin, as whole numbers; rows with node -1 are left out."""
    some = node >= 0
    bins, node, g, h = bins[some], node[some].astype(np.int64), g[some], h[some]
    out = np.empty((n_nodes, len(columns), 3, BINS), np.int64)
    for k, c in enumerate(columns):
        code = node * BINS + bins[:, c]
        for j, w in enumerate((g, h, None)):
            out[:, k, j] = np.bincount(code, w, n_nodes * BINS).reshape(n_nodes, BINS)
    return out


def _shrunk(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_cuts(sums: np.ndarray, p: Params) -> np.ndarray:
    """Of each node and column (first dimensions): gain (-1 if no cut is allowed), bin, then both derivatives and rows to the left and in all."""
    sums = sums.astype(np.float64)  # whole numbers below 2^53, so exact: up to 8 billion rows of the largest derivative in a bin
    total, left = sums.sum(axis=-1), np.cumsum(sums, axis=-1)[..., :-1]
    right = total[..., None] - left
    value = lambda s: _shrunk(s[..., 0, :] / ONE, p.l1) ** 2 / (s[..., 1, :] / ONE + p.l2 + 1e-300)
    gain = value(left) + value(right) - value(total[..., None])
    least, weight = max(1, p.least_rows), p.least_weight * ONE
    ok = (left[..., 2, :] >= least) & (right[..., 2, :] >= least) & (left[..., 1, :] >= weight) & (right[..., 1, :] >= weight)
    gain = np.where(ok, gain, -1.0)
    k = np.argmax(gain, axis=-1)
    at = np.take_along_axis(left, k[..., None, None], axis=-1)[..., 0]
    return np.concatenate([np.take_along_axis(gain, k[..., None], axis=-1), k[..., None], at, total], axis=-1)


def _cut(row: np.ndarray) -> tuple:
    return (float(row[0]), *map(int, row[1:].tolist()))


def auc_of(counts: np.ndarray) -> float:
    """From numbers of rows by label and bin of probability; equal bins count half."""
    neg, pos = counts.astype(float)
    below = np.cumsum(neg) - neg
    total = pos.sum() * neg.sum()
    return float((pos * (below + neg / 2)).sum() / total) if total else 0.5


class _Block:
    """Rows of bins with their labels, margins so far, hashes, and whether they are for validation."""

    def __init__(self, bins, y, valid, margin, uid):
        self.bins, self.y, self.valid, self.margin, self.uid = bins, y, valid, margin, uid

    @staticmethod
    def read(r: dict, width: int) -> _Block:
        f = lambda k, t: np.frombuffer(r[k], t)
        return _Block(f("bins", np.uint8).reshape(-1, width), f("y", np.uint8), f("valid", np.uint8), f("margin", np.float64), f("uid", np.uint64))

    def row(self) -> list[bytes]:
        return [self.bins.tobytes(), self.y.tobytes(), self.valid.tobytes(), self.margin.tobytes(), self.uid.tobytes()]

    def after(self, trees: list[Tree]) -> _Block:
        margin = self.margin
        for t in trees:
            margin = margin + t.margins(self.bins)
        return _Block(self.bins, self.y, self.valid, margin, self.uid)

    def sums(self, number: int, tree: Tree, open_nodes: list[int], columns: list[int], p: Params) -> np.ndarray:
        """Of the open nodes of the tree that grows; only rows that this tree samples count."""
        g, h = derivatives(self.margin, self.y)
        used = self.valid == 0
        if p.rows < 1:
            used &= _mix(self.uid, p.seed * 1_000_003 + number) < p.rows
        place = np.full(len(tree.column), -1)
        place[open_nodes] = range(len(open_nodes))
        node = np.where(used, place[tree.leaf_of(self.bins)], -1)
        return level_sums(self.bins, node, g, h, len(open_nodes), columns)

    def scored(self) -> np.ndarray:
        """Validation rows by label and bin of probability."""
        v = self.valid > 0
        at = np.minimum((sigmoid(self.margin[v]) * AUC_BINS).astype(np.int64), AUC_BINS - 1)
        return np.bincount(at + self.y[v].astype(np.int64) * AUC_BINS, minlength=2 * AUC_BINS).reshape(2, AUC_BINS)


#: What measures a level: (number, tree, open nodes, columns, score?) -> ({(place of node, column): cut}, AUC of the trees before).
Level = Callable[[int, Tree, list[int], list[int], bool], tuple[dict, float | None]]


def grow(p: Params, columns: list[str], edges: list[list[float]], base: float, validated: bool, level: Level, finished: Callable[[Tree], None]) -> Booster:
    """The boosting loop; ``level`` measures open nodes, ``finished`` takes each tree."""
    trees: list[Tree] = []
    history: list[float] = []
    best = 0  # trees of the best AUC
    rng = random.Random(p.seed)
    usable = [k for k, e in enumerate(edges) if e]
    for number in range(p.rounds + 1):
        last = number == p.rounds
        drawn = sorted(rng.sample(usable, max(1, round(p.columns * len(usable))))) if usable else []
        tree, open_nodes, cuts = Tree(), [0], {}
        tree.add(0.0, 0)
        for depth in range(max(1, p.depth)):
            if last and not validated:
                break
            found, score = level(number, tree, open_nodes, drawn, validated and depth == 0)
            if score is not None:
                if number:
                    history.append(score)
                    if score > max(history[:-1], default=-1.0):
                        best = number
                if last or (p.patience and number - best >= p.patience):
                    last = True
                    break
            nxt = []
            for place, node in enumerate(open_nodes):
                mine = [(found[place, c], c) for c in drawn if (place, c) in found]
                if not mine:
                    continue
                if depth == 0:
                    _, _, _, _, _, g, h, n = mine[0][0]
                    tree.value[0], tree.rows[0] = _leaf(g, h, p), n
                (gain, cut, gl, hl, nl, g, h, n), c = max(mine, key=lambda x: (x[0][0], -x[1]))
                if gain <= 1e-12:
                    continue
                tree.column[node], tree.cut[node] = c, cut
                tree.left[node], tree.right[node] = tree.add(_leaf(gl, hl, p), nl), tree.add(_leaf(g - gl, h - hl, p), n - nl)
                cuts[node] = gain
                nxt += [tree.left[node], tree.right[node]]
            open_nodes = nxt
            if not open_nodes:
                break
        if last:
            break
        tree = _best_first(tree, cuts, p.leaves)
        trees.append(tree)
        finished(tree)
    if p.patience and history:
        trees = trees[:best]
    return Booster(columns, edges, base, trees, p, history)


def _leaf(g: float, h: float, p: Params) -> float:
    g, h = g / ONE, h / ONE
    return -math.copysign(max(abs(g) - p.l1, 0.0), g) / (h + p.l2 + 1e-300) * p.rate


def _best_first(tree: Tree, gains: dict[int, float], leaves: int | None) -> Tree:
    """The tree with the best splits only, each taken once its parent is, up to a number of leaves."""
    heap, kept = ([(-gains[0], 0)] if 0 in gains else []), set()
    while heap and (leaves is None or len(kept) + 1 < leaves):
        _, node = heapq.heappop(heap)
        kept.add(node)
        for child in (tree.left[node], tree.right[node]):
            if child in gains:
                heapq.heappush(heap, (-gains[child], child))
    out, todo = Tree(), [0]
    out.add(tree.value[0], tree.rows[0])
    names = {0: 0}
    for node in todo:
        if node in kept:
            at = names[node]
            out.column[at], out.cut[at] = tree.column[node], tree.cut[node]
            for side, child in ((out.left, tree.left[node]), (out.right, tree.right[node])):
                names[child] = out.add(tree.value[child], tree.rows[child])
                side[at] = names[child]
                todo.append(child)
    return out


def in_memory(block: _Block, p: Params, columns: list[str], edges: list[list[float]], base: float) -> Booster:
    """The model of the rows of one block."""
    state = [block]

    def level(number, tree, open_nodes, drawn, score):
        sums = state[0].sums(number, tree, open_nodes, drawn, p)
        cuts = best_cuts(sums, p)
        found = {(i, c): _cut(cuts[i, k]) for i in range(len(open_nodes)) for k, c in enumerate(drawn)}
        return found, auc_of(state[0].scored()) if score else None

    return grow(p, columns, edges, base, bool(block.valid.any()), level, lambda t: state.__setitem__(0, state[0].after([t])))


_BLOCK = "bins binary, y binary, valid binary, margin binary, uid binary"
_CUT = "node int, col int, gain double, cut int, gl long, hl long, nl long, g long, h long, n long"


def _packed(n_columns: int, edges: list[list[float]], base: float, most: int):
    def run(batches):
        held: list[tuple] = []

        def sent():
            x, y, v, u = (np.concatenate(c) for c in zip(*held, strict=True))
            row = _Block(x, y, v, np.full(len(y), base), u).row()
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in row], [c.split()[0] for c in _BLOCK.split(", ")])

        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            values = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(n_columns)], axis=1) if n_columns else np.zeros((b.num_rows, 0))
            held.append((binned(values, edges), b.column("_y").to_numpy().astype(np.uint8), b.column("_valid").to_numpy().astype(np.uint8), b.column("_uid").to_numpy().view(np.uint64)))
            n += b.num_rows
            if n >= most:
                yield sent()
                held, n = [], 0
        if held:
            yield sent()

    return run


def quantile_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper edges of bins by approximate quantiles (mergeable sketches, one pass); fewer where values repeat. Missing values count as zero."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(c), shares, F.lit(20 * bins)).alias(str(k)) for k, c in enumerate(columns)], *[F.max(c).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    # an edge at the largest value would cut off nothing
    return [sorted({float(x) for x in (row[k] or []) if x < row[f"m{k}"]})[: BINS - 1] for k in range(len(columns))]


def fit(df: DataFrame, columns: list[str], params: Params = DEPTH_FIRST, y: str = "y", key: tuple[str, ...] = ("sym", "t"), valid: str | None = None, block_rows: int = BLOCK_ROWS) -> Booster:
    """A booster on rows with a label; ``valid`` names a column that is true for rows to validate on, not to learn from.

    Missing values count as zero. ``key`` names rows, for sampling: rows of one
    key are sampled together. Rows without a label are left out; with no rows
    to learn from there are no trees and the margin is zero.
    """
    spark = df.sparkSession
    send(spark)
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    rows = df.where(F.col(y).isNotNull()).select(
        *[number(c) for c in columns],
        (F.col(y) > 0).cast("int").alias("_y"),
        (F.coalesce(F.col(valid).cast("boolean"), F.lit(False)) if valid else F.lit(False)).cast("int").alias("_valid"),
        F.xxhash64(*key).alias("_uid"),
    )
    rows = checkpointed(rows)
    learn = rows.where("_valid = 0")
    size = learn.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("pos")).first()
    validated = not rows.where("_valid = 1").isEmpty()
    if not size.n:
        return Booster(list(columns), [[] for _ in columns], 0.0, [], params)
    edges = quantile_edges(learn, columns)
    share = min(max(size.pos / size.n, 1e-6), 1 - 1e-6)
    base = math.log(share / (1 - share))
    pack = _packed(len(columns), edges, base, block_rows)
    total = rows.count()
    if total <= block_rows:  # one block: boosted in one task by the same code

        def run(batches):
            for b in pack(batches):
                model = in_memory(_Block.read({k: v[0] for k, v in b.to_pydict().items()}, len(columns)), params, list(columns), edges, base)
                yield pa.RecordBatch.from_arrays([pa.array([model.to_json()])], ["model"])

        return Booster.from_json(rows.repartition(1).mapInArrow(run, "model string").first().model)
    blocks = checkpointed(rows.mapInArrow(pack, _BLOCK))
    return _distributed(blocks, params, list(columns), edges, base, validated)


def _distributed(blocks: DataFrame, p: Params, columns: list[str], edges: list[list[float]], base: float, validated: bool) -> Booster:
    width = len(columns)
    state = {"blocks": blocks, "new": []}  # trees that the blocks' margins don't hold yet

    def level(number, tree, open_nodes, drawn, score):
        new = list(state["new"])

        def sums(batches):
            total, scored = None, np.zeros((2, AUC_BINS), np.int64)
            for b in batches:
                for r in b.to_pylist():
                    block = _Block.read(r, width).after(new)
                    mine = block.sums(number, tree, open_nodes, drawn, p)
                    total = mine if total is None else total + mine
                    if score:
                        scored += block.scored()
            if total is None:
                return
            rows = [(i, c, total[i, k].tobytes()) for i in range(len(open_nodes)) for k, c in enumerate(drawn)]
            rows += [(-1, -1, scored.tobytes())] * score
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["node", "col", "sums"])

        def cut(table: pa.Table) -> pa.Table:
            node, col = table.column("node")[0].as_py(), table.column("col")[0].as_py()
            total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("sums"))
            best = (auc_of(total.reshape(2, AUC_BINS)), 0, 0, 0, 0, 0, 0, 0) if node < 0 else _cut(best_cuts(total.reshape(3, BINS), p))
            names, kinds = zip(*(f.split() for f in _CUT.split(", ")), strict=True)
            kind = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
            return pa.table({n: pa.array([v], kind[t]) for n, t, v in zip(names, kinds, (node, col, *best), strict=True)})

        got = state["blocks"].mapInArrow(sums, "node int, col int, sums binary").groupBy("node", "col").applyInArrow(cut, _CUT).collect()  # a row for each open node and column
        found = {(r.node, r["col"]): (r.gain, r.cut, r.gl, r.hl, r.nl, r.g, r.h, r.n) for r in got}
        auc = found.pop((-1, -1), None)
        return found, auc[0] if auc else None

    def finished(tree):
        state["new"].append(tree)
        if len(state["new"]) == SNAPSHOT:
            new = list(state["new"])

            def moved(batches):
                for b in batches:
                    for r in b.to_pylist():
                        row = _Block.read(r, width).after(new).row()
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in row], b.schema.names)

            state["blocks"], state["new"] = checkpointed(state["blocks"].mapInArrow(moved, _BLOCK)), []

    return grow(p, columns, edges, base, validated, level, finished)


def _values(b: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1) if columns else np.zeros((b.num_rows, 0))


def scored(model: Booster, df: DataFrame, out: str = "p") -> DataFrame:
    """``df`` with the probability of label 1."""
    send(df.sparkSession)
    numbers = [f"_x{k}" for k in range(len(model.columns))]

    def run(batches):
        for b in batches:
            p = sigmoid(model.margins(_values(b, numbers)))
            keep = [k for k, n in enumerate(b.schema.names) if n not in numbers]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(p)], [*(b.schema.names[k] for k in keep), out])

    rows = df.select("*", *[F.col(c).cast("double").alias(n) for c, n in zip(model.columns, numbers, strict=True)])
    return rows.mapInArrow(run, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def shap_values(model: Booster, df: DataFrame, key: tuple[str, ...] = ("sym", "t")) -> DataFrame:
    """``key``, margin, and an array of one attribution a column; with ``model.expected()`` these sum to the margin."""
    send(df.sparkSession)
    rows = df.select(*key, *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(model.columns)])
    numbers = [f"_x{k}" for k in range(len(model.columns))]

    def run(batches):
        for b in batches:
            v = _values(b, numbers)
            phi = model.attributions(v)
            arrays = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * len(numbers), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), pa.array(model.margins(v)), arrays], [*key, "margin", "shap"])

    schema = StructType([*(df.schema[k] for k in key), StructField("margin", DoubleType()), StructField("shap", ArrayType(DoubleType()))])
    return rows.mapInArrow(run, schema)


def shap_importance(model: Booster, df: DataFrame) -> dict[str, float]:
    """Mean absolute attribution of each column over all rows; tasks send one sum a column."""
    at = df.select(F.lit(0).alias("_k"), *model.columns)
    each = shap_values(model, at, key=("_k",)).select(F.posexplode("shap").alias("k", "x")).groupBy("k").agg(F.avg(F.abs("x")).alias("x")).collect()
    got = {r.k: r.x for r in each}
    return {c: got.get(k, 0.0) for k, c in enumerate(model.columns)}


def _attribute(tree: Tree, bins: np.ndarray, out: np.ndarray) -> None:
    """Add the tree's Shapley values, leaf by leaf.

    On the way to a leaf, each distinct column lets a row pass (1 or 0), or,
    if it isn't known, passes the share of training rows that went that way.
    A leaf's part of the Shapley value of a column is the leaf's value times
    the difference of the two, times the sum over subsets of the other columns
    of the path, which is read from the coefficients of their polynomial.
    """
    todo: list[tuple[int, dict[int, tuple[float, int, int]]]] = [(0, {})]  # node, column -> (share, lowest bin, highest bin)
    while todo:
        node, path = todo.pop()
        c = tree.column[node]
        if c >= 0:
            share, low, high = path.get(c, (1.0, 0, BINS - 1))
            for child, a, b in ((tree.left[node], low, min(high, tree.cut[node])), (tree.right[node], max(low, tree.cut[node] + 1), high)):
                todo.append((child, {**path, c: (share * tree.rows[child] / max(1, tree.rows[node]), a, b)}))
            continue
        if not path:
            continue
        columns = list(path)
        d = len(columns)
        passes = np.stack([(bins[:, k] >= path[k][1]) & (bins[:, k] <= path[k][2]) for k in columns]).astype(float)
        shares = [path[k][0] for k in columns]
        weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
        for i, c in enumerate(columns):
            poly = np.zeros((d, len(bins)))  # coefficient of t^k: subsets of k known columns
            poly[0] = 1.0
            for n, j in enumerate([j for j in range(d) if j != i]):
                up = poly[: n + 1] * passes[j]
                poly[: n + 2] *= shares[j]
                poly[1 : n + 2] += up
            out[:, c] += tree.value[node] * (passes[i] - shares[i]) * (np.array(weight) @ poly)
