"""Byte-level BPE by rank files: a segment tree over the byte positions of a pre-token.

A leaf holds the rank of the pair that begins at its position, with the
position in its low bits, so the root is the leftmost pair of lowest rank. A
merge takes the root's pair, links its live neighbours to one another, and
updates three leaves and their ancestors: the pair's own, that of the symbol
merged away, and that of the live neighbour to the left. A node has FAN
children, so a short pre-token's tree is one node and leaves that are near share
their ancestors.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import ship
from .token_counts import slices

#: Low bits of a leaf that hold the position: pre-tokens of up to 2^40 bytes, ranks below 2^22.
AT = 40
#: Children of a node, as a power of two.
FAN_BITS = 4
NO_PAIR = 1 << 62
#: Pre-tokens whose ids a worker remembers, and the longest (in characters) that is remembered.
CACHE, CACHE_CHARS = 800_000, 64
BATCH_CHARS = 1_000_000
#: From so many bytes on, trees are packed arrays (8 bytes a node) in place of lists.
PACKED = 4096


def unicode_spaces(pattern: str) -> str:
    r"""The pattern with ``\s`` and ``\S`` as Unicode white space alone (``regex`` adds U+001C to U+001F)."""
    inside = pattern.replace(r"[^\s", r"[^\p{White_Space}")
    return inside.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


class RankBPE:
    """Encodes and decodes texts with a file of byte strings and ranks, one a line."""

    def __init__(self, model: bytes, pattern: str, cache: int = CACHE):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, model.splitlines()))}
        self.longest = max(map(len, self.ranks))
        self.bytes = [b""] * (1 + max(self.ranks.values()))
        for t, i in self.ranks.items():
            self.bytes[i] = t
        if len(self.bytes) >> (62 - AT):
            raise ValueError("ranks are too large")
        self.find = regex.compile(unicode_spaces(pattern)).findall
        self.limit, self.cache = cache, {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token (not empty)."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, longest, get = len(piece), self.longest, ranks.get
        pack = (lambda x: array("q", x)) if n >= PACKED else list
        leaves = pack([NO_PAIR]) * n
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                leaves[i] = rank << AT | i
        after, before = pack(range(1, n + 2)), pack(range(-1, n))  # live neighbours; n ends the piece
        fan, low = 1 << FAN_BITS, (1 << AT) - 1
        levels = [leaves]
        while len(levels[-1]) > fan:
            levels.append(pack([min(levels[-1][k : k + fan]) for k in range(0, len(levels[-1]), fan)]))
        top = levels[-1]
        while (best := min(top)) < NO_PAIR:
            i = best & low
            gone = after[i]
            right = after[gone]  # where the merged symbol ends
            after[i] = right
            leaf = NO_PAIR
            if right < n:
                before[right] = i
                end = after[right]
                if end - i <= longest and (rank := get(piece[i:end])) is not None:
                    leaf = rank << AT | i
            leaves[i] = leaf
            leaves[gone] = NO_PAIR
            left = before[i]
            if left >= 0:
                leaf = NO_PAIR
                if right - left <= longest and (rank := get(piece[left:right])) is not None:
                    leaf = rank << AT | left
                leaves[left] = leaf
            if top is not leaves:
                nodes = {i >> FAN_BITS, gone >> FAN_BITS, max(left, 0) >> FAN_BITS}
                for lower, upper in zip(levels, levels[1:], strict=False):
                    changed = set()
                    for k in nodes:
                        least = min(lower[k << FAN_BITS : (k + 1) << FAN_BITS])
                        if upper[k] != least:
                            upper[k] = least
                            changed.add(k >> FAN_BITS)
                    nodes = changed  # above a node that stays as it is nothing changes
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers; special strings are plain text."""
        out = []
        for t in texts:
            if len(self.cache) > self.limit:
                self.cache.clear()
            pieces = self.find(t)
            known = list(map(self.cache.get, pieces))
            if None in known:
                for k, p in enumerate(pieces):
                    if known[k] is None and (x := self.cache.get(p)) is None:
                        x = np.array(self.encode_piece(p.encode()), "<u4").tobytes()
                        if len(p) <= CACHE_CHARS:
                            self.cache[p] = x
                        known[k] = x
                    elif known[k] is None:
                        known[k] = x
            out.append(np.frombuffer(b"".join(known), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def encode_by_ranks(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """Encode every whole text: ``id_col``, n_tokens and, as asked, ids (array of int), ids_sha256, decoded_sha256.

    Each match of ``pattern`` is encoded by itself; there are no special
    tokens. The digests are of the ids (unsigned 32-bit, little-endian) and of
    the bytes decoded from them. A null text counts as empty: no ids. An empty
    table gives an empty result; repeated rows are each encoded; other columns
    are not looked at. Texts of any length are encoded whole, an unsplit one in
    memory of about 50 bytes a byte. Narrow: no shuffle.
    """
    spark = docs.sparkSession
    ship.ship(spark)
    model = ship.broadcast_file(spark, ranks_path)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, n_tokens long" + ", ids array<int>" * keep_ids + ", ids_sha256 string, decoded_sha256 string" * digests
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        bpe = RankBPE(model.value, pattern)
        for batch in batches:
            every = batch.column("text").to_pylist()
            for i, j in slices([len(t) for t in every], BATCH_CHARS):
                ids = bpe.encode(every[i:j])
                cols = [batch.column("id").slice(i, j - i), pa.array([len(x) for x in ids], pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), pa.array(np.concatenate(ids).astype(np.int32))))
                if digests:
                    cols.append(pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]))
                    cols.append(pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]))
                yield pa.RecordBatch.from_arrays(cols, names)

    return ship.keyed_text(docs, id_col, text_col).mapInArrow(run, fields).withColumnRenamed("id", id_col)
