from collections import Counter

from oracle import rows_of, sql_rows
from pyspark.sql import functions as F

from tidelake.llm import mixing
from tidelake.llm.mixing import mix, mix_counts
from tidelake.llm.queries import op10_mixing
from tidelake.llm.sql import mixing_sql

SF = "/root/testdata/sf0.001"


def test_same_as_sql(spark):
    assert rows_of(op10_mixing(spark, SF)) == sql_rows(mixing_sql(), SF)


def test_cases(spark, monkeypatch):
    rows = [(i, "a b c " * (i % 7 + 1), f"s{0 if i % 3 else i % 10}") for i in range(600)] + [(1000, None, "s0"), (1001, "", "empty"), (1002, "x y", None), (1002, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("weight", F.lit(1)).withColumn("copies", F.lit("c"))
    got = {r.doc_id: r for r in mix_counts(docs, max_passes=2.5).collect()}
    assert len(got) == 603 and got[1001].copies == 0 and got[1002].quota <= 2.5 * 4
    used, quota = Counter(), {}
    for i, t, s in rows:
        used[s] += got[i].copies * got[i].tokens
        quota[s] = got[i].quota
    assert all(quota[s] - 21 <= used[s] <= quota[s] for s in quota), (used, quota)
    out = mix(docs, max_passes=2.5)
    assert out.columns == docs.columns
    taken = Counter(r.doc_id for r in out.collect())
    assert all(taken[i] == r.copies * (2 if i == 1002 else 1) for i, r in got.items())
    monkeypatch.setattr(mixing, "MAX_SENT", 0)  # the table of sources joined by key
    assert Counter(r.doc_id for r in mix(docs, max_passes=2.5).collect()) == taken
    assert mix(docs.limit(0)).count() == 0 and mix_counts(docs.limit(0)).count() == 0
