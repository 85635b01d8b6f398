import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelake.llm import chat
from tidelake.llm.queries import op3_chat
from tidelake.llm.template import Node, Template, TemplateError, fold, parse

HARD = st.text(alphabet=st.sampled_from("\\#</turn>: \nab"), max_size=40) | st.lists(st.sampled_from(["\\", "###", "</turn>", ": ", " </turn>\n", "### ", "x", "\\\\"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(HARD | st.just("assistant"), HARD), max_size=4))
def test_round_trip(turns):
    t = Template(chat.TEMPLATE, {"escape": chat.escape})
    piece = chat._Piece()
    for s, m in t.pieces({"messages": [{"role": r, "content": c} for r, c in turns]}):
        piece.add(s, m)
    text = "".join(piece.text)
    assert chat.read_turns(text) == turns
    assert "".join(chat.unescape(text[s["start"] : s["end"]]) for s in piece.spans) == "".join(c for r, c in turns if r == "assistant")


def test_reading_is_linear():
    def took(n):
        text = chat.HEAD + "user" + chat.COLON + chat.escape("</turn>" * n + "\\" * n) + chat.END
        began = time.perf_counter()
        assert chat.read_turns(text) == [("user", "</turn>" * n + "\\" * n)]
        return time.perf_counter() - began

    took(1000)
    assert min(took(80_000) for _ in range(3)) < 40 * min(took(10_000) for _ in range(3))


def test_templates():
    assert Template("{% for m in ms %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}").text(ms=[{}, {}, {}]) == "1,2,3"
    assert Template("a {%- if x == 'q' and not y -%} b {%- elif x %}c{% else %}d{% endif %}{# no #}").text(x="q") == "ab"
    assert Template("{% set z = 'p' ~ 1 + 2 %}{{ z | upper }}{{ m['k'] | trim }}").text(m={"k": " v "}) == "P12v"
    assert Template("{{ x.__class__ }}{{ x.y.z }}").text(x="s") == ""
    assert fold(parse("a{{ 'b' | upper }}{% if 1 == 2 %}no{% else %}c{% endif %}")) == Node("block", None, (Node("const", "aBc"),))
    for bad in ("{% for %}", "{% if x %}", "{{ a b }}", "{{ x | nope }}", "{% exec x %}", "{{ (1 }}", "{% endfor %}"):
        with pytest.raises(TemplateError):
            Template(bad)


def expected(rows):
    """Result rows by plain loops."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, role, t in mine if role == "assistant")
        turns = "".join(f"{role}\n{t}\n" for _, role, t in mine)
        out[conv] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op3_chat(spark, sf).collect()}
    assert got == expected(rows)


def test_cases(spark, monkeypatch):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"), (2, 5, "assistant", "long text " * 150_000), (2, 6, "user", "u"), (2, 7, "assistant", "z" * 1_200_000), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1))
    out = chat.format_conversations(df)
    assert {(r.conv_id, r.piece) for r in out.select("conv_id", "piece").collect()} == {(1, 0), (2, 0), (2, 1), (3, 0)}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(out).collect()}
    assert got == expected(rows)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
