import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidelake.llm.components import components
from tidelake.llm.queries import op8_simhash
from tidelake.llm import simhash
from tidelake.llm.simhash import fingerprint, near_duplicates, one_of_each


def brute_fp(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    """Smallest id reachable, by plain search; fps: id -> fingerprint."""
    ids, out = sorted(fps), {}
    for i in ids:
        if i in out:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += [y for y in ids if y not in out and bin(fps[x] ^ fps[y]).count("1") <= 4]
    return out


def test_small(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefghijkl") * rnd.randint(1, 3) for _ in range(60)) for _ in range(6)]
    texts = [None, "", " \n", "one", "One", "two words", *base]
    for b in base:
        for _ in range(12):
            w = b.split(" ")
            w[rnd.randrange(60)] = "zz"
            texts.append(" ".join(w))
    texts += ["é漢 " * 5000, "A\x0bB\x0cC D E", base[0].upper(), "x" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, "one")], "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute_classes(fps)
    assert near_duplicates(docs).count() == len(texts) + 1 and near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    got = op8_simhash(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = {r.doc_id: brute_fp(r.text) for r in docs}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_classes(fps)


def test_spark_hash_is_the_same(spark):
    text = "the same hash as xxhash64 é"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)
    assert fingerprint("a b c") == xxhash.xxh64_intdigest(b"a b c", 42)


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)] + [(7, None), (9, 9)]
    none = components(spark.createDataFrame([], "a long, b long"))
    assert none.columns == ["node", "component"] and none.count() == 0
    assert components(spark.createDataFrame([(5, 5), (None, 1)], "a long, b long")).count() == 0
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for i in sorted(near):
        todo = [] if i in want else [i]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = i
                todo += near[x]
    assert got == want


def test_hot_block_keys(spark, monkeypatch):
    """Keys with more fingerprints than a part: the same classes."""
    monkeypatch.setattr(simhash, "PART", 8)
    rnd = random.Random(11)
    low = [rnd.getrandbits(40) for _ in range(60)]
    fps = {0x123456 << 40 | x for x in low} | {0x123456 << 40 | x ^ (1 << rnd.randrange(40)) for x in low for _ in range(2)}
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = {r.fp & (2**64 - 1): r.label & (2**64 - 1) for r in simhash.classes(df).collect()}
    want = brute_classes({x: x for x in fps})
    assert {x: got.get(x, x) for x in fps} == want and len(set(want.values())) < len(fps)


def test_one_of_each(spark):
    text = "a text of some words that is here more than once in the table"
    rows = [(3, text, "x"), (2, text, "y"), (2, text, "y"), (None, text, "z"), (5, "another text that stands alone in here", None), (5, "another text that stands alone in here", None)]
    rows += [(None, "this one has no id at all but must not be lost", "w"), (None, "", "e"), (9, None, "n"), (7, "same id other text of this small table", "q"), (7, "and this is the other text of the same id", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    got = one_of_each(docs)
    assert got.columns == docs.columns
    want = [(2, text, "y"), rows[4], rows[6], (9, None, "n"), rows[9], rows[10]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert one_of_each(docs.limit(0)).count() == 0
    ids = near_duplicates(docs).collect()
    assert len(ids) == len(rows) and {r.component_id for r in ids if r.doc_id is None} == {2, 9, None} and not any(r.kept for r in ids if r.doc_id is None)
