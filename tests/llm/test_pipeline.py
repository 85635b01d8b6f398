"""The pipeline against plain loops over its own stages' inputs."""

import hashlib
from collections import Counter

import corpus_pipeline as cp
import public_tokenizers
from test_quality import brute as base_figures
from test_simhash import brute_classes, brute_fp
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, seen = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == cols
        seen.append(docs.collect())
    raw, clean, lang, single, mixed, ids = seen
    texts = {r.doc_id: r.text for r in raw}
    for r in clean:
        n, _, _, _, again = base_figures(texts[r.doc_id])
        assert n >= 10 and 100 * again <= 20 * n
        assert set(r.text.split("\n")) <= set(texts[r.doc_id].split("\n")) and r.n_chars == len(r.text)
    assert len(clean) > 0.6 * len(raw)
    assert {r.doc_id for r in lang} <= {r.doc_id for r in clean} and len(lang) >= 0.99 * len(clean)
    classes = brute_classes({r.doc_id: brute_fp(r.text) for r in lang})
    assert sorted(r.doc_id for r in single) == sorted({c for c in classes.values()})
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in single}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), tuple(lib.encode(r.text, add_special_tokens=False).ids)) for r in mixed)
    assert Counter((r.doc_id, r.decoded_sha256, tuple(r.ids)) for r in ids) == want
    again = cp.run(spark, SF)
    assert Counter(r.ids_sha256 for r in again.collect()) == Counter(r.ids_sha256 for r in ids)


def odd_rows():
    good = "The quick brown fox jumps over the lazy dog by the river, and then it sleeps until the evening comes."
    other = "A second text of a good length that has little to do with the first one, and stands in the table once."
    french = "Le petit chat dort dans la maison pendant que la pluie tombe sur le jardin et que le vent souffle."
    rows = [(1, good, "en", "a", 5, "r", 0), (1, good, "en", "a", 5, "r", 0), (2, None, "en", "a", 0, "r", 0), (3, "", None, None, None, None, None), (None, other, "en", "b", 9, "k", 1)]
    rows += [(5, "²½ 12 -- …", "en", "b", 3, "x", 2), (6, good, "en", None, 5, "same text", 3), (7, (french + "\n") + "w" * 200_000, "fr", "b", 0, "x", 4), (8, french, "fr", "a", 1, "x", 5)]
    return rows


def odd(spark):
    """Null in every column, empty, long, repeated and letterless texts, and columns that clash with names inside."""
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long, row string, kept int")


def test_stages_on_odd_rows(spark):
    docs, raw = odd(spark), odd_rows()
    for name, stage in cp.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == "bpe encoding" or out.columns == docs.columns)
    clean = cp.clean(spark, docs, SF).collect()
    assert sorted(r.doc_id or -1 for r in clean) == [-1, 1, 1, 6, 8]  # the long word of 7 is most of its text and no sentence
    assert {r.row for r in clean if r.doc_id is None} == {"k"}
    known = cp.known_language(spark, docs, SF).collect()
    assert {r.doc_id for r in known} <= {1, None, 6, 7, 8} and None in {r.doc_id for r in known}
    single = cp.one_of_each(spark, docs, SF).collect()
    assert sorted(map(repr, map(tuple, single))) == sorted(repr(raw[i]) for i in (0, 2, 4, 5, 7, 8))
    mixed = cp.mixed(spark, docs, SF).collect()
    assert {tuple(r) for r in mixed} <= set(raw)
    ids = cp.encode(spark, docs, SF).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids) == Counter((r[0], tuple(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in raw)


def test_repeats_and_null_ids_through_the_pipeline(spark, tmp_path):
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(r.doc_id for r in cp.run(spark, str(tmp_path)).collect())
    assert set(got) <= {1, None, 7, 8}
