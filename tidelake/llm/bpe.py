"""Byte-level BPE encoding and decoding of whole texts by tree concatenation.

A text is cut at special strings and into pre-tokens. The bytes of a long
pre-token (text without a cut) are halved down to leaves; all leaves are
encoded together (``merge``), then neighbours are joined level by level. At a
join a window of tokens on both sides is encoded anew and grows until its
first token is the left side's and its last token the right side's own. A
token sequence is the encoding of its text if and only if every two
neighbours are the encoding of theirs; neighbours inside either side and
inside the window are, so the joined sequence is exact.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship
from .merge import PairTable, merge_batch
from .token_counts import slices

# Fixed value: the pre-token pattern of byte-level BPE vocabularies (Unicode white space only).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of a leaf; longer pre-tokens are built as trees.
LEAF = 24
#: Pre-tokens whose ids a worker remembers, and the longest that is remembered.
CACHE, CACHE_BYTES = 800_000, 64
BATCH_SYMBOLS, BATCH_CHARS = 200_000, 1_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class ByteBPE:
    """Encodes and decodes texts with a tokenizer.json of kind byte-level BPE."""

    def __init__(self, model: bytes, cache: int = CACHE, leaf: int = LEAF):
        spec = json.loads(model)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.first = np.array([vocab[x] for x in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.table = PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {x: b for b, x in enumerate(letters)}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}
        self.limit, self.leaf = cache, leaf

    def _merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, all merged together."""
        out: list[np.ndarray] = []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i, j in slices(lengths.tolist(), BATCH_SYMBOLS):
            sym, left = merge_batch(self.first[np.frombuffer(b"".join(pieces[i:j]), np.uint8)], lengths[i:j], self.table)
            out += np.split(sym, np.cumsum(left)[:-1])
        return out

    def _join(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Each left and right side as one sequence; windows of all pairs are encoded together."""
        out: list = [None] * len(pairs)
        todo, k = list(range(len(pairs))), 2
        while todo:
            windows = [b"".join(map(self.bytes.__getitem__, [*pairs[i][0][-k:].tolist(), *pairs[i][1][:k].tolist()])) for i in todo]
            again = []
            for i, mid in zip(todo, self._merge(windows), strict=True):
                a, b = pairs[i]
                if (k >= len(a) or mid[0] == a[-k]) and (k >= len(b) or mid[-1] == b[k - 1]):
                    out[i] = np.concatenate([a[: max(0, len(a) - k)], mid, b[k:]])
                else:
                    again.append(i)
            todo, k = again, k * 2
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of unsplit pieces (not empty); those over a leaf as trees, all trees level by level."""
        leaves: list[bytes] = []
        spans = []
        for p in pieces:
            n = 1
            while len(p) > n * self.leaf:
                n *= 2
            cuts = [len(p) * i // n for i in range(n + 1)]
            spans.append(n)
            leaves += [p[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        ids = self._merge(leaves)
        trees, at = [], 0
        for n in spans:
            trees.append(ids[at : at + n])
            at += n
        while tall := [t for t in range(len(trees)) if len(trees[t]) > 1]:
            joined = iter(self._join([(trees[t][i], trees[t][i + 1]) for t in tall for i in range(0, len(trees[t]), 2)]))
            for t in tall:
                trees[t] = [next(joined) for _ in range(len(trees[t]) // 2)]
        return [t[0] for t in trees]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        if len(self.cache) > self.limit:
            self.cache.clear()
        special = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        parts = []
        for t in texts:
            if self.split and any(s in t for s in special):
                parts.append([x for s in self.split.split(t) for x in ([s] if s in special else self.find(s))])
            else:
                parts.append(self.find(t))
        known = [list(map(self.cache.get, p)) for p in parts]
        new = {k for p, c in zip(parts, known, strict=True) if None in c for k, v in zip(p, c, strict=True) if v is None}
        found = {s: special[s] for s in new & special.keys()}
        rest = sorted(new - special.keys(), key=len)
        found |= zip(rest, [x.astype("<u4").tobytes() for x in self.encode_pieces([k.encode() for k in rest])], strict=True)
        out = [b"".join([found[k] if v is None else v for k, v in zip(p, c, strict=True)] if None in c else c) for p, c in zip(parts, known, strict=True)]
        self.cache.update((k, v) for k, v in found.items() if len(k) <= CACHE_BYTES and k not in special)
        return [np.frombuffer(x, "<u4") for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """Encode every whole text: ``id_col``, n_tokens and, as asked, ids (array of int), ids_sha256, decoded_sha256.

    The digests are of the ids (unsigned 32-bit, little-endian) and of the
    text decoded from them. A null text counts as empty: no ids. An empty
    table gives an empty result; repeated rows are each encoded; other columns
    are not looked at. Texts of any length are encoded whole. Narrow: no shuffle.
    """
    spark = docs.sparkSession
    ship.ship(spark)
    model = ship.broadcast_file(spark, model_path)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, n_tokens long" + ", ids array<int>" * keep_ids + ", ids_sha256 string, decoded_sha256 string" * digests
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        bpe = ByteBPE(model.value)
        for batch in batches:
            every = batch.column("text").to_pylist()
            for i, j in slices([len(t) for t in every], BATCH_CHARS):
                ids = bpe.encode(every[i:j])
                cols = [batch.column("id").slice(i, j - i), pa.array([len(x) for x in ids], pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), pa.array(np.concatenate(ids).astype(np.int32))))
                if digests:
                    cols.append(pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]))
                    cols.append(pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]))
                yield pa.RecordBatch.from_arrays(cols, names)

    return ship.keyed_text(docs, id_col, text_col).mapInArrow(run, fields).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of encoded rows: ``id_col``, text. Null ids give a null text, empty ids an empty text.

    Every row is decoded, repeated ones and those with a null id too; an empty
    table gives an empty result; other columns are not looked at.
    """
    spark = encoded.sparkSession
    ship.ship(spark)
    model = ship.broadcast_file(spark, model_path)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = ByteBPE(model.value)
        for b in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
