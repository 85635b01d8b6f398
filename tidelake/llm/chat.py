"""Chat formatting with compiled templates, loss spans, and the way back.

Rows of a conversation stream through its template in the order of turns, so a
conversation never has to be in memory at once; long ones leave in pieces.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship
from .template import Template

# The control strings of the format.
HEAD, COLON, END = "### ", ": ", " </turn>\n"
CONTROL = re.compile(r"\\|###|</turn>|: ")
ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
TEMPLATE = (
    "{% for message in messages %}### {{ message.role | escape }}: "
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}"
    "{% else %}{{ message.content | escape }}{% endif %} </turn>\n{% endfor %}"
)
#: A piece is closed at the first end of a turn after so many characters.
PIECE_CHARS = 1_000_000


def escape(text: str | None) -> str:
    """Control strings get a backslash in front, as does a backslash."""
    return CONTROL.sub(lambda m: "\\" + m[0], text or "")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _find(text: str, what: str, at: int) -> int:
    """The first place of a control string that isn't escaped, or -1."""
    while (i := text.find(what, at)) >= 0:
        j = i
        while j and text[j - 1] == "\\":
            j -= 1
        if (i - j) % 2 == 0:
            return i
        at = i + 1
    return -1


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns, unescaped."""
    out, at = [], 0
    while at < len(text):
        colon = _find(text, COLON, at + len(HEAD))
        end = _find(text, "</turn>", colon + len(COLON))
        if not text.startswith(HEAD, at) or colon < 0 or end < 0:
            raise ValueError("this isn't a row of whole turns")
        out.append((unescape(text[at + len(HEAD) : colon]), unescape(text[colon + len(COLON) : end - 1])))
        at = end - 1 + len(END)
    return out


class _Piece:
    """Text and spans that gather until they are cut off."""

    def __init__(self):
        self.text: list[str] = []
        self.spans: list[dict] = []
        self.size = 0

    def add(self, s: str, marked: bool) -> None:
        if marked and s:
            if self.spans and self.spans[-1]["end"] == self.size:
                self.spans[-1]["end"] += len(s)
            else:
                self.spans.append({"start": self.size, "end": self.size + len(s)})
        self.text.append(s)
        self.size += len(s)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _formatted(rows, compiled: Template, turn_end: str):
    """(id, number, text, spans) of the pieces of each conversation; rows (id, role, text) come in order."""
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        number, piece = 0, _Piece()
        for s, marked in compiled.pieces({"messages": ({"role": r, "content": t} for _, r, t in group)}):
            piece.add(s, marked)
            if piece.size >= PIECE_CHARS and s.endswith(turn_end):
                yield conv, number, "".join(piece.text), piece.spans
                number, piece = number + 1, _Piece()
        if piece.size or not number:
            yield conv, number, "".join(piece.text), piece.spans


def format_conversations(df: DataFrame, template: str = TEMPLATE, turn_end: str = END, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted conversations: ``id_col``, piece, text, spans (start, end of what is trained on, in code points).

    Rows are taken by turn, then role and text, so ties have a fixed order and
    repeated rows are turns like others. Null roles and texts are empty. A
    conversation of more than PIECE_CHARS leaves in several pieces, each cut
    after ``turn_end``; pieces of one conversation follow one another in one
    partition. An empty table gives an empty result; other columns are not
    looked at. The rows of a conversation are read as a sorted stream by one
    task, of which only a piece and a row are in memory.
    """
    ship.ship(df.sparkSession)
    name = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        kind: list[pa.DataType] = []

        def stream():
            for b in batches:
                kind[:] = [b.schema.field("id").type]
                yield from zip(*(b.column(c).to_pylist() for c in ("id", "role", "text")), strict=True)

        def packed(done):
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], SPANS)], ["id", "piece", "text", "spans"])

        done, size = [], 0
        for x in _formatted(stream(), Template(template, {"escape": escape}), turn_end):
            done.append(x)
            size += len(x[2])
            if size >= PIECE_CHARS or len(done) >= 2000:
                yield packed(done)
                done, size = [], 0
        if done:
            yield packed(done)

    dealt = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"id {name}, piece long, text string, spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations: turns, text under the loss mask, lengths and digests.

    The pieces must be as ``format_conversations`` leaves them (no shuffle since).
    """
    name = formatted.schema[id_col].dataType.simpleString()

    def run(batches):
        kind: list[pa.DataType] = []

        def stream():
            for b in batches:
                kind[:] = [b.schema.field("id").type]
                yield from zip(*(b.column(c).to_pylist() for c in ("id", "text", "spans")), strict=True)

        def rows():
            for conv, pieces in itertools.groupby(stream(), key=lambda r: r[0]):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = 0
                for _, text, spans in pieces:
                    for role, content in read_turns(text):
                        turns.update(f"{role}\n{content}\n".encode())
                        n += 1
                    for s in spans:
                        part = unescape(text[s["start"] : s["end"]])
                        loss.update(part.encode())
                        loss_chars += len(part)
                    chars += len(text)
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        it = rows()
        while some := list(itertools.islice(it, 2000)):
            cols = list(zip(*some, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind[0]), *(pa.array(c) for c in cols[1:])], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    out = formatted.select(F.col(id_col).alias("id"), "text", "spans").mapInArrow(run, f"id {name}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", id_col)
