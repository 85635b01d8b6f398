"""Token counts of whole texts by rank-synchronous array merging.

The vocabulary is a sentencepiece BPE model with byte fallback. Texts are cut
into pre-tokens at spaces (no piece has a space mark after another character),
distinct pre-tokens of a batch are merged together as ragged arrays
(``merge``), and what survives is counted: one token for a piece, the UTF-8
bytes of a character that is in no piece.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import ship
from .merge import PairTable, merge_batch

MARK = "▁"
#: Pre-tokens whose counts a worker remembers.
CACHE, CACHE_CHARS = 800_000, 16_000_000
#: Symbols merged at once.
BATCH_SYMBOLS = 200_000
#: Texts handled at once, in characters.
BATCH_CHARS = 4_000_000


def _fields(buf: bytes) -> Iterator[tuple[int, int, object]]:
    """Fields of a protocol-buffer message: number, wire type, value."""
    i = 0

    def varint(i):
        v = s = 0
        while True:
            b = buf[i]
            v |= (b & 127) << s
            i += 1
            if b < 128:
                return v, i
            s += 7

    while i < len(buf):
        tag, i = varint(i)
        n, kind = tag >> 3, tag & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 1:
            v, i = buf[i : i + 8], i + 8
        elif kind == 2:
            size, i = varint(i)
            v, i = buf[i : i + size], i + size
        else:
            v, i = buf[i : i + 4], i + 4
        yield n, kind, v


def read_pieces(model: bytes) -> tuple[list[str], list[float]]:
    """Normal pieces of a sentencepiece model and their scores."""
    pieces, scores = [], []
    for n, _, v in _fields(model):
        if n != 1:
            continue
        text, score, kind = "", 0.0, 1
        for m, _, x in _fields(v):
            if m == 1:
                text = x.decode()
            elif m == 2:
                score = struct.unpack("<f", x)[0]
            elif m == 3:
                kind = x
        if kind in (1, 4):  # normal, user-defined
            pieces.append(text)
            scores.append(score)
    return pieces, scores


class Counter:
    """Counts tokens of texts; keeps the counts of pre-tokens it has seen."""

    def __init__(self, model: bytes, cache: int = CACHE):
        pieces, scores = read_pieces(model)
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space mark inside; texts can't be cut at spaces")
        self.ids = {p: i for i, p in enumerate(dict.fromkeys([*pieces, *sorted({c for p in pieces for c in p})]))}
        levels = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        rank = {p: levels[s] for p, s in zip(pieces, scores, strict=True)}
        rows = [(self.ids[p[:k]], self.ids[p[k:]], rank[p], self.ids[p]) for p in pieces for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self.table = PairTable(*(np.array(x) for x in zip(*rows, strict=True)))
        # tokens that a symbol stands for: 1, or its bytes if it is a character that is no piece
        known = set(pieces)
        self.worth = np.array([1 if s in known else len(s.encode()) for s in self.ids] + [0, 1, 2, 3, 4], np.int64)
        # the symbol of each code point: of those in no piece, one that only has its bytes
        code = np.arange(0x110000)
        self.symbol = (len(self.ids) + 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)).astype(np.int32)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.cache: dict[str, int] = {}
        self.limit, self.held = cache, 0

    def pre_tokens(self, text: str) -> list[str]:
        """Keys of a text's pre-tokens; key k stands for k with one more space before it."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in re.findall(" +[^ ]*", f" {text}")]
        return text.split(" ")

    def learn(self, keys: list[str]) -> None:
        """Count the given pre-tokens, many at once."""
        lengths = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
        for i, j in slices(lengths.tolist(), BATCH_SYMBOLS):
            flat = f" {' '.join(keys[i:j])}".replace(" ", MARK)
            sym, left = merge_batch(self.symbol[np.frombuffer(flat.encode("utf-32-le"), np.uint32)], lengths[i:j], self.table)
            totals = np.add.reduceat(self.worth[sym], np.r_[0, np.cumsum(left)[:-1]])
            self.cache.update(zip(keys[i:j], totals.tolist(), strict=True))
        self.held += sum(map(len, keys))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.cache) > self.limit or self.held > CACHE_CHARS:
            self.cache.clear()
            self.held = 0
        parts = [self.pre_tokens(t) for t in texts]
        counts = [list(map(self.cache.get, p)) for p in parts]
        new: set[str] = set()
        for p, c in zip(parts, counts, strict=True):
            if None in c:
                new.update(k for k, n in zip(p, c, strict=True) if n is None)
        self.learn(list(new))
        known = self.cache.__getitem__
        return [sum(map(known, p)) if None in c else sum(c) for p, c in zip(parts, counts, strict=True)]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Tokens of every whole text: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. An empty table gives an
    empty result; rows that repeat are each counted; other columns are not
    looked at. Texts of any length are merged whole. Narrow: no shuffle.
    """
    spark = docs.sparkSession
    ship.ship(spark)
    model = ship.broadcast_file(spark, model_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = Counter(model.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            counts = []
            for i, j in slices([len(t) for t in texts], BATCH_CHARS):
                counts += counter.count(texts[i:j])
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = ship.keyed_text(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
