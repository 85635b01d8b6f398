"""Encoding by ranks against the public library."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelake.llm import segment_bpe
from tidelake.llm.queries import op12_segment_bpe
from tidelake.llm.segment_bpe import RankBPE, encode_by_ranks

FILE, MULTI = (public_tokenizers.path(f) for f in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIB, LIB_MULTI = library(FILE), library(MULTI)
HARD = ["", "a", " ", "   a", "a  b   c", "\n\n a\n", "<|endoftext|> x", "\x00\x01é漢字🙂 \x1c\x85\x1f ​　 a", "a" * 999, " " * 49 + "x", "-=" * 700, "\r\n\t it's I'LL we're", "ß́ ١٢٣ ⅷ"]
alphabets = st.sampled_from(["ab", "theinanor", "a-=", "  \n\tthe", "ééa漢\U0001f600\r;)} 's'll\x1c\x85"])
texts = alphabets.flatmap(lambda a: st.text(alphabet=a, max_size=200))


@pytest.fixture(scope="module")
def both():
    return [(RankBPE(open(f, "rb").read(), public_tokenizers.PATTERN), lib) for f, lib in ((FILE, LIB), (MULTI, LIB_MULTI))]


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(texts, st.text(max_size=60)))
def test_like_the_library(both, text):
    for own, lib in both:
        ids = own.encode([text])[0]
        assert ids.tolist() == lib.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_long_unsplit(both, monkeypatch):
    text = "".join(random.Random(1).choice("theinanorsdc") for _ in range(30_000)) + "a" * 3000
    for packed in (1, 1 << 30):
        monkeypatch.setattr(segment_bpe, "PACKED", packed)
        for own, lib in both:
            assert own.encode([text])[0].tolist() == lib.encode_ordinary(text)


def test_cache_is_bounded():
    own = RankBPE(open(FILE, "rb").read(), public_tokenizers.PATTERN, cache=10)
    for k in range(30):
        t = " ".join(f"w{k}x{j}" for j in range(9)) + "z" * 100
        assert own.encode([t])[0].tolist() == LIB.encode_ordinary(t)
        assert all(len(p) <= segment_bpe.CACHE_CHARS for p in own.cache) and len(own.cache) <= 10 + len(t)


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate([*HARD, *HARD[:3]])] + [(99, None, "x"), (99, None, "x"), (None, "abc", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(repr, ((r.doc_id, list(r.ids)) for r in encode_by_ranks(docs, FILE, public_tokenizers.PATTERN).collect())))
    assert got == sorted(map(repr, ((i, LIB.encode_ordinary(t or "")) for i, t, _ in rows)))
    assert encode_by_ranks(docs.limit(0), FILE, public_tokenizers.PATTERN).count() == 0


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_segment_bpe(spark, sf).collect()}
    want = {}
    for r in docs:
        ids = LIB.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(LIB.decode_bytes(ids)).hexdigest())
    assert got == want
