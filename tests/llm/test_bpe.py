"""Token counts and encoding against the public libraries."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidelake.llm import token_counts
from tidelake.llm.bpe import ByteBPE, decode_ids, encode_texts
from tidelake.llm.queries import op1_token_counts, op2_bpe
from tidelake.llm.token_counts import Counter, count_tokens

SP, BB = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", "a", " ", "   a", "a  b   c", "\n\n a\n", "▁ ▁a", "<s> x </s>", "\x00\x01é漢字🙂 \x1c\x85", "a" * 999, " " * 49 + "x", "-=" * 700, "a<|endoftext|> b<|endoftext|>"]
LIB_SP, LIB_BB = SentencePieceProcessor(model_file=SP), Tokenizer.from_file(BB)
alphabets = st.sampled_from(["ab", "theinanor", "a-=", "  \n\tthe", "ééa漢\U0001f600\r;)} 's'll"])
texts = alphabets.flatmap(lambda a: st.text(alphabet=a, max_size=200))


@pytest.fixture(scope="module")
def counter():
    return Counter(open(SP, "rb").read())


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(open(BB, "rb").read(), leaf=3)


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_like_the_libraries(counter, bpe, text):
    assert counter.count([text]) == [len(LIB_SP.encode(text))]
    ids = bpe.encode([text])[0]
    want = LIB_BB.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert bpe.decode(ids) == LIB_BB.decode(want, skip_special_tokens=False) == text



def test_queries_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    one = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op1_token_counts(spark, sf).collect()}
    assert one == {r.doc_id: (len((r.text or "").encode()), n := len(LIB_SP.encode(r.text or "")), n > 4096) for r in docs}
    two = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_bpe(spark, sf).collect()}
    want = {}
    for r in docs:
        ids = LIB_BB.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(LIB_BB.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert two == want


def test_cache_is_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_CHARS", 1000)
    c = Counter(open(SP, "rb").read())
    for k in range(30):
        text = " ".join(f"w{k}x{j}" * 9 for j in range(5))
        assert c.count([text]) == [len(LIB_SP.encode(text))]
        assert c.held <= 1000 + len(text) and sum(map(len, c.cache)) <= c.held


def test_long_unsplit(counter, bpe):
    text = "".join(random.Random(1).choice("theinanorsdc") for _ in range(40_000))
    assert counter.count([text]) == [len(LIB_SP.encode(text))]
    assert bpe.encode([text])[0].tolist() == LIB_BB.encode(text, add_special_tokens=False).ids


def test_operators(spark):
    rows = [(i, t, "x") for i, t in enumerate([*HARD, *HARD[:3]])] + [(99, None, "x"), (99, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, count_tokens(docs, SP, limit=5).collect()))
    want = sorted((i, len((t or "").encode()), n := len(LIB_SP.encode(t or "")), n > 5) for i, t, _ in rows)
    assert got == want
    ids = encode_texts(docs, BB, digests=True)
    assert sorted((r.doc_id, tuple(r.ids)) for r in ids.collect()) == sorted((i, tuple(LIB_BB.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted(map(tuple, decode_ids(ids, BB).collect())) == sorted((i, t or "") for i, t, _ in rows)
    assert count_tokens(docs.limit(0), SP).count() == encode_texts(docs.limit(0), BB).count() == 0
