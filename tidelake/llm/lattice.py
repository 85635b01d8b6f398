"""Embedding near-duplicates by lattice hashing.

Each table projects unit vectors at random to two times eight coordinates and
decodes both halves to points of the E8 lattice; a pair of points is a cell.
A vector lies in its own cell and also probes two neighbours: for each half in
turn, the nearest point of the lattice's other coset. Vectors that meet in a
cell are compared by cosine in double precision; a pair counts in the one of
its cells that has the lowest hash.

Only ids, hashes and 64-bit sketches (signs of random projections) are dealt to
cells. Vectors whose sketch is near no other one of their cell leave it; the
limit loses a pair at the threshold once in a million. Cells all of whose
vectors share one cell of a lower hash go, as their pairs meet there. Vectors
are then sent to what is left, large cells in pairs of parts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship
from .components import components
from .groups import MAX_SENT, groups, parted


THRESHOLD = 0.95
TABLES, SCALE, SEED = 12, 0.65, 20240601
SKETCH_BITS, SKETCH_LOSS = 64, 1e-6
#: Vectors of a cell that are compared in one piece, at most; larger cells are dealt to pairs of parts.
PART = 4096
#: Cells of up to so many vectors are compared by lists of pairs, larger ones by blocks of so many rows.
SMALL, BLOCK = 48, 512
#: Components of vectors that are multiplied together; pairs looked at together.
PRODUCTS, PAIRS = 2_000_000, 200_000


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest points of D8 (integers with an even sum) and squared distances."""
    p = np.rint(x)
    off = x - p
    odd = np.flatnonzero(p.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    p[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return p, ((x - p) ** 2).sum(axis=1)


def decode_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the nearest point of E8 and twice the nearest of its other coset, as integers."""
    a, da = _d8(x)
    b, db = _d8(x - 0.5)
    a, b = (2 * a).astype(np.int64), (2 * b + 1).astype(np.int64)
    first = (da <= db)[:, None]
    return np.where(first, a, b), np.where(first, b, a)


def _mix(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of integer rows."""
    h = np.full(len(points), (salt * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1), np.uint64)
    for c in points.T.astype(np.uint64):
        h = (h ^ c) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def cells(unit: np.ndarray, tables: int = TABLES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """Hashes of the cells of each unit vector: row, table, (own, neighbour, neighbour)."""
    dim = unit.shape[1]
    rng = np.random.default_rng([seed, dim])
    out = np.empty((len(unit), tables, 3), np.uint64)
    for t in range(tables):
        g = rng.standard_normal((dim, 16)) * scale
        y = unit @ g + rng.random(16)
        (p, p2), (q, q2) = decode_e8(y[:, :8]), decode_e8(y[:, 8:])
        hp, hp2, hq, hq2 = (_mix(x, dim << 16 | 2 * t + h) for x, h in ((p, 0), (p2, 0), (q, 1), (q2, 1)))
        for k, (a, b) in enumerate(((hp, hq), (hp2, hq), (hp, hq2))):
            out[:, t, k] = a ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


def sketches(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """64 signs of random projections of each unit vector."""
    g = np.random.default_rng([seed, unit.shape[1], SKETCH_BITS]).standard_normal((unit.shape[1], SKETCH_BITS))
    return np.packbits(unit @ g > 0, axis=1).view(np.uint64).ravel()


def sketch_limit(threshold: float) -> int:
    """The fewest differing bits that a pair at the threshold exceeds with a chance of at most SKETCH_LOSS."""
    p, below = math.acos(min(1.0, max(-1.0, threshold))) / math.pi, 0.0
    for b in range(SKETCH_BITS + 1):
        below += math.comb(SKETCH_BITS, b) * p**b * (1 - p) ** (SKETCH_BITS - b)
        if below >= 1 - SKETCH_LOSS:
            return b
    return SKETCH_BITS


def near_sketches(first: np.ndarray, sketch: np.ndarray, limit: int) -> np.ndarray:
    """Which rows have another of their cell within the limit; ``first`` tells where cells begin."""
    out = np.zeros(len(sketch), bool)
    sizes = np.diff(np.r_[first, len(sketch)])
    some = (sizes > 1) & (sizes <= SMALL)
    for a, b in _few(first[some], sizes[some], PAIRS):
        near = np.bitwise_count(sketch[a] ^ sketch[b]) <= limit
        out[a[near]] = out[b[near]] = True
    for at, m in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        mine = sketch[at : at + m]
        for i in range(0, m, BLOCK):
            left = np.arange(i, min(i + BLOCK, m))
            for j in range(0, m, BLOCK):
                near = np.bitwise_count(mine[left, None] ^ mine[j : j + BLOCK]) <= limit
                near &= left[:, None] != np.arange(j, min(j + BLOCK, m))
                found = near.any(axis=1)
                out[at + left[found]] = True
                left = left[~found]
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Unit rows in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_size(vectors: pa.Array):
    """Places and unit rows of the vectors of each size."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(np.r_[0, sizes[:-1]])
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        yield at, unit_rows(flat[begin[at][:, None] + np.arange(d)])


def unmet(ca: np.ndarray, cb: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the pairs that meet in no cell of a lower hash than ``key`` (cells of different tables never meet)."""
    left = np.arange(len(ca))
    for t in range(ca.shape[1]):
        a, b, k = ca[left, t], cb[left, t], key[left]
        met = np.zeros(len(left), bool)
        for x in range(3):
            met |= ((b == a[:, x, None]).any(axis=1)) & (a[:, x] < k)
        left = left[~met]
        if not len(left):
            break
    return left


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Bring together what links connect; ``root`` holds the smallest place that each place reaches."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != (up := root[root])).any():
            root[:] = up


def _few(first: np.ndarray, sizes: np.ndarray, most: int):
    """Places (a < b) of all pairs of small cells, some at a time."""
    for m in np.unique(sizes):
        at = first[sizes == m]
        x, y = np.triu_indices(int(m), 1)
        for i in range(0, len(at), step := max(1, most // len(x))):
            here = at[i : i + step, None]
            yield (here + x).ravel(), (here + y).ravel()


def _met(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether rows of two blocks share a hash (0 is none), as a matrix."""
    names = np.intersect1d(mine, other)
    out = np.zeros((len(mine), len(other)), bool)
    names = names[names > 0]
    for i in range(0, len(names), BLOCK):
        some = names[i : i + BLOCK]
        marks = []
        for x in (mine, other):
            at = np.minimum(np.searchsorted(some, x), len(some) - 1)
            row, col = np.nonzero(some[at] == x)
            m = np.zeros((len(x), len(some)), np.float32)
            m[row, at[row, col]] = 1
            marks.append(m)
        out |= (marks[0] @ marks[1].T) > 0
    return out


class _Cells:
    """Rows of some cells that follow one another, the links found and what they connect."""

    def __init__(self, key, part, apart, n, own, unit, threshold):
        self.key, self.part, self.apart, self.n, self.own, self.unit, self.threshold = key, part, apart, n, own, unit, threshold
        self.links, self.root = np.zeros(len(key), np.int64), np.arange(len(key))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Count close pairs that meet in no lower cell."""
        for i in range(0, len(a), PAIRS):
            x, y = a[i : i + PAIRS], b[i : i + PAIRS]
            new = unmet(self.own[x], self.own[y], self.key[x])
            x, y = x[new], y[new]
            self.links += np.bincount(x, self.n[y], len(self.key)).astype(np.int64) + np.bincount(y, self.n[x], len(self.key)).astype(np.int64)
            join(self.root, x, y)

    def small(self, first: np.ndarray, sizes: np.ndarray) -> None:
        for a, b in _few(first, sizes, PRODUCTS // self.unit.shape[1]):
            near = np.einsum("ij,ij->i", self.unit[a], self.unit[b]) >= self.threshold
            near &= ~self.apart[a] | (self.part[a] != self.part[b])
            self.pairs(a[near], b[near])

    def large(self, at: int, m: int) -> None:
        """One cell by blocks; pairs that share its most common lower cell are left to that one."""
        here = slice(at, at + m)
        lower = self.own[here].reshape(m, -1)
        lower = np.where(lower < self.key[at], lower, np.uint64(0))
        names, count = np.unique(lower[lower > 0], return_counts=True)
        rest = np.ones(m, bool)
        if len(names):
            rest = ~(lower == names[count.argmax()]).any(axis=1)
        rows = np.flatnonzero(rest)
        for i in range(0, len(rows), BLOCK):
            mine = rows[i : i + BLOCK]
            for j in range(0, m, BLOCK):
                other = np.arange(j, min(j + BLOCK, m))
                if rest[other].all() and other[-1] < mine[0]:
                    continue  # seen from the other side
                near = self.unit[at + mine] @ self.unit[at + other].T >= self.threshold
                # a pair of two rows of the rest is seen twice, any other once
                near &= ~rest[other] | (other > mine[:, None])
                if self.apart[at]:
                    near &= self.part[at + other] != self.part[at + mine][:, None]
                hits = np.count_nonzero(near)
                if hits * 20 < near.size:
                    a, b = np.nonzero(near)
                    self.pairs(at + mine[a], at + other[b])
                    continue
                near &= ~_met(lower[mine], lower[other])
                self._dense(at + mine, at + other, near)

    def _dense(self, mine: np.ndarray, other: np.ndarray, near: np.ndarray) -> None:
        full = near.astype(np.float64)
        np.add.at(self.links, mine, np.rint(full @ self.n[other]).astype(np.int64))
        np.add.at(self.links, other, np.rint(self.n[mine] @ full).astype(np.int64))
        while True:
            y = self.root[other]
            open_ = near & (self.root[mine][:, None] != y)
            a = np.flatnonzero(open_.any(axis=1))
            if not len(a):
                return
            least = np.where(open_[a], np.arange(len(other)), len(other)).min(axis=1)
            join(self.root, mine[a], other[least])


def link_cells(key: np.ndarray, first: np.ndarray, apart: np.ndarray, part: np.ndarray, n: np.ndarray, own: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of some cells (copies counted), and the smallest place that links reach.

    Rows of a cell follow one another; ``first`` tells where cells begin. Where
    ``apart`` holds, only pairs of rows of different parts count.
    """
    found = _Cells(key, part, apart, n, own, unit, threshold)
    sizes = np.diff(np.r_[first, len(key)])
    some = (sizes > 1) & (sizes <= SMALL)
    found.small(first[some], sizes[some])
    for at, m in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        found.large(at, m)
    return found.links, found.root


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """``id_col``, n_links, component_id, kept of every row.

    Links rows whose cosine is at least ``threshold``, among those that meet in
    a cell; equal vectors (by two 64-bit hashes) always link, and are hashed and
    compared once for all copies. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing; vectors of different sizes
    don't meet. Ids are integers, unique by contract; a null id links with
    nothing; a repeated row counts as a vector of its own. An empty table gives
    an empty result; other columns are not looked at. Cells of any size
    are compared whole, in pairs of parts of about PART vectors.
    """
    spark = df.sparkSession
    ship.ship(spark)
    kind = df.schema[id_col].dataType.simpleString()
    v = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.withColumn("ok", F.coalesce(~bad & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull(), F.lit(False)))
    good = v.where("ok")
    hashed = good.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    reps = ship.checkpointed(hashed.groupBy("h1", "h2").agg(F.min("id").alias("rid"), F.count("*").alias("n")))

    def find(unit):
        return cells(unit, tables, scale, seed)

    def deal(batches):
        for b in batches:
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            for at, unit in by_size(b.column("v")):
                own = np.sort(find(unit).reshape(len(at), -1), axis=1)
                keep = np.r_["1", np.ones((len(at), 1), bool), own[:, 1:] != own[:, :-1]]
                each = keep.sum(axis=1)
                marks = np.repeat(sketches(unit, seed).view(np.int64), each)
                yield pa.RecordBatch.from_arrays([pa.array(own[keep].view(np.int64)), pa.array(np.repeat(rid[at], each)), pa.array(marks)], ["key", "rid", "sketch"])

    def prune(batches):
        limit = sketch_limit(threshold)
        for t, first in groups(batches, "key", "p", "q"):
            keep = near_sketches(first, t.column("sketch").to_numpy().view(np.uint64), limit)
            yield from t.select(["key", "rid"]).filter(pa.array(keep)).combine_chunks().to_batches()

    def link(batches):
        for t, first in groups(batches, "key", "p", "q"):
            key, rid, n, p, q, part = (t.column(c).to_numpy() for c in ("key", "rid", "n", "p", "q", "part"))
            key, cell = key.view(np.uint64), np.zeros(len(rid), np.int64)
            cell[first] = 1
            cell = np.cumsum(cell)
            once = np.r_[True, (rid[1:] != rid[:-1]) | (cell[1:] != cell[:-1])]  # of a repeated row one is compared
            for at, unit in by_size(t.column("v")):
                at, unit = at[once[at]], unit[once[at]]
                start = np.flatnonzero(np.r_[True, np.diff(cell[at]) > 0])
                links, root = link_cells(key[at], start, p[at] != q[at], part[at], n[at], find(unit), unit, threshold)
                mine = rid[at]
                tree, some = np.flatnonzero(root != np.arange(len(at))), np.flatnonzero(links)
                a, b = np.r_[mine[tree], mine[some]], np.r_[mine[root[tree]], mine[some]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.r_[np.zeros(len(tree), np.int64), links[some]])], ["a", "b", "links"])

    def sent(small: DataFrame) -> DataFrame:
        """Broadcast behind a check of its rows."""
        return F.broadcast(small) if small.limit(MAX_SENT + 1).count() <= MAX_SENT else small

    dealt = good.select(F.col("id").alias("rid"), "v").join(sent(reps.select("rid")), "rid", "left_semi").mapInArrow(deal, f"key long, rid {kind}, sketch long")
    shared = ship.checkpointed(dealt.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"))
    inside = parted(ship.checkpointed(dealt.join(sent(shared), "key", "left_semi")), "key", "rid", PART)
    inside = inside.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(prune, f"key long, rid {kind}")
    inside = ship.checkpointed(inside.distinct())  # a row of a large cell is in several pairs of parts
    # the lowest cell of each vector; a cell all of whose vectors have one lower cell in common has no pair of its own.
    # hashes are compared as unsigned numbers
    order = F.col("key").bitwiseXOR(F.lit(-(2**63)))
    low = inside.groupBy("rid").agg(F.min(order).alias("low"))
    marked = inside.join(low, "rid")
    needed = marked.groupBy("key").agg(F.min("low").alias("x"), F.max("low").alias("y")).where(~((F.col("x") == F.col("y")) & (F.col("x") < order))).select("key")
    needed = ship.checkpointed(inside.join(needed, "key", "left_semi"))
    cut = parted(needed, "key", "rid", PART).join(reps.select("rid", "n"), "rid")
    meet = good.select(F.col("id").alias("rid"), "v").join(cut, "rid")
    meet = meet.select("key", "p", "q", "part", "rid", "n", "v").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "rid")
    found = ship.checkpointed(meet.mapInArrow(link, f"a {kind}, b {kind}, links long"))
    total = found.where("links > 0").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    classes = components(found.where("links = 0")).withColumnRenamed("node", "rid")
    known = reps.join(total, "rid", "left").join(classes, "rid", "left")
    known = known.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("component_id"))
    out = hashed.join(known, ["h1", "h2"]).select("id", "n_links", "component_id")
    out = out.unionByName(v.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
