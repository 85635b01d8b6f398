"""The filter audit against its SQL and against plain loops over documents, orders and steps."""

import itertools
import re
from collections import Counter

from oracle import rows_of, sql_rows

from tidelake.llm import filter_audit
from tidelake.llm.filter_audit import MEASURES, audit
from tidelake.llm.queries import op13_filter_audit
from tidelake.llm.sql import filter_audit_sql


def failed(doc, text, docs):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
    return out + "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * any(i is not None and doc is not None and i < doc and (t or "") == text for i, t, _ in docs)


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    cases = Counter((lang or "", failed(i, t or "", docs), i in good, i in toxic) for i, t, lang in docs)
    out = []
    for part in {c[0] for c in cases}:
        mine, removed_by = [(c[1:], n) for c, n in cases.items() if c[0] == part], Counter()
        rows = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[0][0]]
                left = [x for x in left if f not in x[0][0]]
                n = lambda xs: sum(k for _, k in xs)
                removed_by[f] += n(here)
                rows.append([part, order, step, n(left), n(here), n([x for x in mine if f in x[0][0]]) - n(here), n([x for x in mine if x[0][0] == f]), n([x for x in here if x[0][1]]), n([x for x in here if x[0][2]])])
        out += [(*r, removed_by[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in ("part", "filter_order", "step", *MEASURES)) for r in df.collect())


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = rows_of(op13_filter_audit(spark, sf))
    assert got == sql_rows(filter_audit_sql(), sf) and len(got[1]) % 600 == 0 and got[1]


def test_cases(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(220))
    texts = [long, long, "AB " * 300, "a b # " * 100, None, "", long + " #", "\x1c\x85 ééé AB" + long, "a " * 199, "a " * 200, " ".join(f"v{i % 100}" for i in range(200)), "ABC" + "d" * 97, "ABCD" + "d" * 96]
    langs = ["en", None, "de", "", "en"]
    docs = [(i, t, langs[i % 5]) for i, t in enumerate(texts * 3)] + [(None, long, "en"), (None, long, "en"), (0, long, "de"), (0, long, "de"), (None, None, None), (50, "x" * 300_000, "fr")]
    labels = [(i, i % 2, (i + 1) % 3 % 2) for i in range(0, 30)] + [(3, 0, None), (None, 1, 1), (3, None, 1), (900, 1, 1)]
    d = spark.createDataFrame([(*r, "x", 5) for r in docs], "doc_id long, text string, lang string, mask string, n int").repartition(5)
    x = spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, part int")
    want = brute(docs, labels)
    assert rows(audit(d, x)) == want and len(want) == 600 * 4
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 1)
    assert rows(audit(d, x)) == want
    assert rows(audit(d, x.limit(0))) == brute(docs, []) and rows(audit(d.limit(0), x)) == []
