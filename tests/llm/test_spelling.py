"""Spelling variants against a plain version that compares by sets of deletions."""

import random
import re
import zlib
from collections import Counter, defaultdict

from tidelake.llm import spelling
from tidelake.llm.queries import op11_spelling
from tidelake.llm.spelling import Automaton, near_words, variants


def brute_counts(rows):
    """n of each word, from (id, text)."""
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    """Rows from counts: words that share what is left after a deletion are compared."""
    by = defaultdict(set)
    for w in n:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for some in by.values():
        for a in some:
            near[a] |= {b for b in some if a != b and one_apart(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def rows(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def test_automaton_numbers_words():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(300)} | {"tops", "taps", "top", "tap"})
    a = Automaton(words)
    for i, w in enumerate(words):
        state, number = a.walk(a.root, 0, w)
        assert number == i and a.final[state]
    assert a.size[a.root] == len(words)
    # minimal: no two states accept the same words
    accepted = []

    def behind(s):
        return frozenset(([""] if a.final[s] else []) + [c + x for c, (_, t) in a.edges[s].items() for x in behind(t)])

    accepted = [behind(s) for s in range(len(a.edges))]
    assert len(set(accepted)) == len(accepted)


def test_near_words_as_by_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(900)} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa"}
    want = sorted((a, b, len(b)) for a in words for b in words if one_apart(a, b))
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    assert sorted(map(tuple, near_words(df).collect())) == want
    monkeypatch.setattr(spelling, "GROUP_WORDS", 20)  # the groups are cut into parts
    assert sorted(map(tuple, near_words(df).collect())) == want
    assert near_words(df.limit(0)).count() == 0


def test_cases(spark):
    text = "Colourful " * 400 + "colorful " * 40 + "coloful " * 2 + "x×y÷zabc abcdefg ABCDEFG Étéétéé Étéétéé lonely1lonely " + "colorfol, colorfol; "
    data = [(i, text if i < 3 else None, "x") for i in range(5)] + [(None, text, "x"), (None, "", "x"), (7, "longunsplit" * 5000 + " " + "longunsplit" * 5000, "x"), (1, text, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, word string")
    got = rows(variants(df))
    assert got == brute(brute_counts([r[:2] for r in data]))
    by = {r[0]: r for r in got}
    assert by["coloful"][3] == "colorful" and by["coloful"][5] == "colourful" and "Étéétéé" in by
    assert rows(variants(df.limit(0))) == [] and rows(variants(df.where("text is null"))) == []


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = rows(op11_spelling(spark, sf))
    assert got == brute(brute_counts([tuple(r) for r in docs])) and any(r[3] for r in got)
