import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidelake.llm import lattice, queries
from tidelake.llm.lattice import cells, decode_e8, near_vectors


def brute(rows):
    """Links (ids) and classes by all pairs; rows: (id, vector)."""
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for (i, a), (j, b) in itertools.combinations(ok, 2):
        if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
            links[i].add(j)
            links[j].add(i)
    return links


def classes(links):
    out = {}
    for i in sorted(links):
        todo = [] if i in out else [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += links[x]
    return out


def test_decoder():
    rng = np.random.default_rng(0)
    p, q = decode_e8(rng.normal(size=(500, 8)) * 2)
    for x in (p, q):
        assert ((x % 2 == 0).all(1) | (x % 2 == 1).all(1)).all() and (x.sum(1) % 4 == 0).all()
    x = rng.normal(size=(300, 8))
    near, _ = decode_e8(x)
    shifts = [np.array(s) for s in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, s)) == 2]
    for s in shifts:  # no neighbour is nearer
        assert (((x - near / 2) ** 2).sum(1) <= ((x - near / 2 - s) ** 2).sum(1) + 1e-9).all()


def test_recall_and_counts(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 64))
    rows = [(i, v) for i, v in enumerate(base)]
    for k in range(300):
        v = base[k % 20]
        noise = rng.normal(size=64) * np.linalg.norm(v) / 8 * rng.uniform(0.05, 0.33)
        rows.append((1000 + k, v + noise))
    rows += [(2000, base[0]), (2001, base[0] * 3), (2002, -base[0])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(3000, None), (3001, [0.0] * 64), (3002, [float("nan")] * 64), (3003, [1.0, None]), (3004, []), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (3007, [float("inf")] * 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1))
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    n_want, n_got = sum(map(len, want.values())), sum(r.n_links for r in got.values())
    assert 0.9 * n_want <= n_got <= n_want, (n_got, n_want)
    assert all(r.n_links <= len(want[i]) for i, r in got.items())
    same = sum(r.component_id == classes(want)[i] for i, r in got.items())
    assert same >= 0.97 * len(rows)
    assert [got[i].n_links for i in (3000, 3001, 3002, 3003, 3004, 3007)] == [0] * 6
    assert got[3005].n_links == got[3006].n_links == 1 and got[3006].component_id == 3005
    assert near_vectors(df.limit(0)).count() == 0


def test_large_cell(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=64)
    rows = [(i, (v + rng.normal(size=64) * 0.02).tolist()) for i in range(1300)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in got} == {1299} and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_parts_of_cells(spark, monkeypatch):
    """Cells in many parts and blocks give the same links."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(5, 32))
    rows = [(i, (base[i % 5] + rng.normal(size=32) * rng.uniform(0.02, 0.3)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, near_vectors(df).collect()))
    monkeypatch.setattr(lattice, "PART", 40)
    monkeypatch.setattr(lattice, "SMALL", 6)
    monkeypatch.setattr(lattice, "BLOCK", 16)
    assert sorted(map(tuple, near_vectors(df).collect())) == plain
    want, n_links = brute(rows), {r[0]: r[1] for r in plain}
    assert all(n_links[i] <= len(w) for i, w in want.items()) and sum(n_links.values()) >= 0.95 * sum(map(len, want.values()))


def test_a_cell_of_many(spark):
    """A group of 9,000 near copies: every pair is counted."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=16)
    x = v + rng.normal(size=(9_000, 16)) * 0.02
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(9_000), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = near_vectors(df).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(8_999, 0, 9_000)]


def test_recall_by_cosine():
    """Shares of pairs that meet in a cell, at the threshold and above it."""
    rng = np.random.default_rng(8)
    for dim in (64, 384):
        a, b = rng.normal(size=(2, 600, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        for cos, least in ((0.95, 0.95), (0.96, 0.98), (0.98, 0.995)):
            ca, cb = cells(a), cells(cos * a + (1 - cos**2) ** 0.5 * b)
            met = (ca[:, :, :, None] == cb[:, :, None, :]).any(axis=(1, 2, 3))
            assert met.mean() >= least, (dim, cos, met.mean())


def test_sketches():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 20_000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = lattice.sketches(a), lattice.sketches(0.95 * a + (1 - 0.95**2) ** 0.5 * b)
    off = np.bitwise_count(x ^ y)
    assert lattice.sketch_limit(0.95) < 25 and off.max() <= lattice.sketch_limit(0.95) and lattice.sketch_limit(-1) == 64
    sketch = np.array([0, 1, 2**64 - 1, 3, 2**63], np.uint64)
    assert lattice.near_sketches(np.array([0, 3]), sketch, 2).tolist() == [True, True, False, True, False][:3] + [False, False]
    many = np.concatenate([sketch[[2]], np.zeros(1000, np.uint64), sketch[[2]] >> np.uint64(32)])
    assert lattice.near_sketches(np.array([0]), many, 3).tolist() == [False] + [True] * 1000 + [False]


def test_query_with_planted_copies(spark, tmp_path):
    """The query over given rows and copies of them with noise, against brute force."""
    rng = np.random.default_rng(9)
    x = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, r.embedding) for r in x][:300]
    for k in range(400):
        v = np.array(rows[k % 60][1], float)
        rows.append((10_000 + k, (v + rng.normal(size=len(v)) * np.linalg.norm(v) / len(v) ** 0.5 * rng.choice([0, 0.05, 0.15, 0.3])).astype(np.float32).tolist()))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.op7_lattice(spark, str(tmp_path)).collect()}
    want = brute(rows)
    total = sum(map(len, want.values()))
    assert set(got) == set(want) and total > 1000 and all(r.n_links <= len(want[i]) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * total
    assert sum(classes(want)[i] == r.component_id for i, r in got.items()) >= 0.98 * len(rows)


def test_repeated_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (4, [1.0, 2.0, 3.1]), (None, v), (6, [-1.0, 0.0, 0.5])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in got) == [(-1, 0, -1, False), (1, 2, 1, True), (1, 2, 1, True), (4, 2, 1, False), (6, 0, 6, True)]
