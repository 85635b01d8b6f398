import numpy as np
from pyspark.sql import functions as F

from tidelake.llm import langid
from tidelake.llm.gru import ByteGRU, pad
from tidelake.llm.langid import identify
from tidelake.llm.queries import op6_language


def test_gradient():
    net = ByteGRU(3, hidden=4, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, n = pad([b"abc", b"a", b"hello", "é".encode()])
    label = np.array([0, 1, 2, 1])
    _, grad = net.loss(x, n, label)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in v.shape)
            if k[1:] == "x":
                i = (ord("l"), i[1])
            old, eps = v[i], 1e-3
            v[i] = old + eps
            up = net.loss(x, n, label)[0]
            v[i] = old - eps
            down = net.loss(x, n, label)[0]
            v[i] = old
            assert abs((up - down) / (2 * eps) - grad[k][i]) < 2e-3, (k, i)


def test_reader_sums_the_labels():
    """The fast reader against the forward pass that training uses, one window at a time."""
    net = ByteGRU(3, hidden=8, seed=5)
    words = [b"abc", b"xyz", b"\xc3\xa9 1", b"longer text, 2"]
    want = []
    for w in words:
        x, n = pad([w])
        y, _ = net._logits(x, n)
        e = np.exp(y - y.max(axis=2, keepdims=True))
        want.append((e / e.sum(axis=2, keepdims=True)).sum(axis=(0, 1)))
    read = net.reader()
    got = [read(np.frombuffer(w, np.uint8)[None])[0] for w in words]
    assert np.allclose(got, want, atol=1e-4)
    both = read(np.stack([np.frombuffer(w, np.uint8) for w in words[:2]]))
    assert np.allclose(both, want[:2], atol=1e-4)


def test_windows():
    text = "The  river, 12 km\u00a0long;\n" + "\u6f22\u5b57" * 40 + " \u0e44\u0e17\u0e22 end" + "x" * 100
    cut = langid.windows(text)
    assert all(0 < len(w) <= langid.WINDOW for w in cut) and all(w.decode() for w in cut)
    assert "".join(b"".join(cut).decode().split()) == "".join(text.lower().split())
    assert b"the  river, 12 km" in cut[0] and langid.windows(" \n") == langid.windows("") == []
    assert not langid.has_letter("\u00b2 \u00bd \u2167 12 \u2026") and langid.has_letter("12 \u6f22") and langid.has_letter("\u00e9")


def test_sample_keeps_every_language(spark, monkeypatch):
    rows = [(i, f"text of words number {i} in here", f"l{i % 250:03d}") for i in range(1000)] + [(2000 + i, "\u6f22\u5b57" * 200, "zz") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_windows(docs, "lang", "text", "doc_id", F.lit(True))
    assert {lang for lang, _ in sample} == {r[2] for r in rows}
    assert sum(lang == "zz" for lang, _ in sample) == 3 * langid.DOC_WINDOWS
    monkeypatch.setattr(langid, "TRAIN_DOCS", 2)
    assert len(langid.training_windows(docs.where("lang = 'l001'"), "lang", "text", "doc_id", F.lit(True))) == 2


def test_unsegmented_script(spark):
    """Runs of letters far longer than a window are learned and told apart."""
    rng = np.random.default_rng(2)
    make = lambda a, n: "".join(chr(a + int(x)) for x in rng.integers(0, 60, n))
    rows = [(i, make(0x4E00, 300), "zh") for i in range(40)] + [(100 + i, make(0x0E01, 300), "th") for i in range(40)] + [(200 + i, " ".join(make(97, 5)[:4] for _ in range(30)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(docs, F.col("doc_id") % 2 == 0).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op6_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score"), F.max("score")).first()
    print(r)
    assert r.a > 0.97


def test_cases(spark):
    docs = spark.createDataFrame([(1, "hello there world", "en"), (2, "bonjour monde ça", "fr"), (3, None, "fr"), (4, "123 --", "en"), (5, "", None), (7, "\u00b2 \u00bd \u2167 3", "en"), (6, "wörld" * 20_000, None), (1, "hello there world", "en")], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in identify(docs, F.lit(True)).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "fr" and got[6].lang_pred in ("en", "fr")
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (3, 4, 5, 7))
    assert identify(docs.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in identify(docs, F.lit(False)).collect()} == {"und"}


def plain_windows(text):
    """The same windows by a loop: from the first byte that is no space, the longest piece of up to WINDOW bytes that ends before a space or at the end, else before a character."""
    raw, out, i = text.lower().encode("utf-8", "replace"), [], 0
    space = b"\t\n\v\f\r "
    while i < len(raw):
        if raw[i] in space:
            i += 1
            continue
        ends = range(min(i + langid.WINDOW, len(raw)), i, -1)
        end = next((e for e in ends if e == len(raw) or raw[e] in space), None) or next(e for e in ends if not 0x80 <= raw[e] < 0xC0)
        out.append(raw[i:end])
        i = end
    return out


def plain_probabilities(net, window):
    """Every byte's labels by the gates' equations, one byte and one direction after another, in double precision."""
    h, p = net.h, {k: v.astype(np.float64) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    states = {}
    for d, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
        s = np.zeros(h)
        for t in order:
            a, r = p[f"{d}x"][window[t]] + p[f"{d}b"], s @ p[f"{d}u"]
            z, g = sig(a[:h] + r[:h]), sig(a[h : 2 * h] + r[h : 2 * h])
            s = (1 - z) * np.tanh(a[2 * h :] + g * r[2 * h :]) + z * s
            states[d, t] = s
    total = 0
    for t in range(len(window)):
        y = np.exp(np.concatenate([states["f", t], states["b", t]]) @ p["o"] + p["ob"])
        total = total + y / y.sum()
    return total


def test_predictions_by_a_plain_version(spark, monkeypatch):
    """From the weights that the query learns: windows, gates, pooling over all bytes and the choice, one document at a time."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train_on = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    langs, net = langid.train(langid.training_windows(docs, "lang", "text", "doc_id", train_on), steps=60)
    monkeypatch.setattr(langid, "train", lambda sample: (langs, net))  # the query reads with the same weights
    got = {r.doc_id: r for r in op6_language(spark, sf).collect()}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(rows)
    some = sorted((r for r in rows if len(r.text) < 800), key=lambda r: r.doc_id)[:30]
    assert len(some) > 20
    for r in some:
        if not any(map(str.isalpha, r.text)):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        cut = plain_windows(r.text)
        assert cut == langid.windows(r.text)
        pooled = sum(plain_probabilities(net, w) for w in cut)
        share = pooled / sum(map(len, cut))
        assert abs(got[r.doc_id].score - share.max()) < 1e-3 and got[r.doc_id].lang_pred == langs[int(share.argmax())]
