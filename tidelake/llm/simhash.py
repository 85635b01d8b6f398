"""SimHash near-duplicates: fingerprints, pigeonhole blocks, links and classes.

A fingerprint's 64 bits are split into BLOCKS blocks. Two fingerprints with at
most MAX_BITS differing bits agree on at least BLOCKS - MAX_BITS whole blocks,
so joining on every choice of that many blocks loses no pair. The rows of one
such key are linked by a search that compares each fingerprint with those not
reached yet: a group of thousands of near copies yields a spanning tree, not
all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship
from .components import components
from .groups import groups, parted

SEED = 42
SHINGLE = 4
MAX_BITS = 4
BLOCKS = 6
#: Fingerprints of one block key that are compared in one piece, at most.
PART = 4096
#: Shingles whose bits are added up at once.
STEP = 50_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as an unsigned integer; 0 if it has no word."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``fp`` (signed 64 bits) of every whole text. Narrow.

    Null, empty and blank texts have fingerprint zero. Every row gets its own,
    repeated ones and those with a null id too; texts may be of any length; an
    empty table gives an empty result; other columns are not looked at.
    """
    ship.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return ship.keyed_text(docs, id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


def block_keys(fps: np.ndarray, blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> np.ndarray:
    """Keys of each fingerprint, one for every choice of blocks (rows: fingerprints)."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        key = np.full(len(fps), t, np.uint64)
        for c in chosen:
            key = (key << np.uint64(cuts[c + 1] - cuts[c])) | parts[c]
        keys.append(key)
    return np.stack(keys, axis=1)


def span(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) that hold together what is within max_bits of each other, directly or by others."""
    left, a, b = np.arange(len(fps)), [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        near = np.bitwise_count(fps[left] ^ fps[x]) <= max_bits
        if near.any():
            hit = left[near]
            a.append(np.full(len(hit), x))
            b.append(hit)
            queue += hit.tolist()
            left = left[~near]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def classes(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``fp``, ``label`` (the smallest fingerprint reachable) of every fingerprint that has another near it.

    fps: distinct fingerprints, column ``fp``. A block key with more than PART
    of them is dealt to pairs of parts. No rows give no rows.
    """

    def deal(batches):
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            keys = block_keys(fps.view(np.uint64), blocks, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, keys.shape[1]))], ["key", "fp"])

    def link(batches):
        for t, first in groups(batches, "key", "p", "q"):
            fps = t.column("fp").to_numpy()
            bits, sizes = fps.view(np.uint64), np.diff(np.r_[first, len(fps)])
            pair = first[sizes == 2]
            pair = pair[np.bitwise_count(bits[pair] ^ bits[pair + 1]) <= max_bits]
            found = [(pair, pair + 1)]
            for at, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                x, y = span(bits[at : at + n], max_bits)
                found.append((x + at, y + at))
            a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], ["a", "b"])

    dealt = parted(fps.mapInArrow(deal, "key long, fp long"), "key", "fp", PART).drop("part")
    links = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(link, "a long, b long")
    return components(links).select(F.col("node").alias("fp"), F.col("component").alias("label"))


def _labelled(docs_fp: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """Each fingerprint's smallest id and label."""
    distinct = docs_fp.groupBy("fp").agg(F.min("id").alias("first"))
    return distinct.join(classes(distinct.select("fp"), max_bits, blocks), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits), component_id, kept of every document.

    Documents are linked when their fingerprints differ in at most ``max_bits``
    bits; component_id is the smallest id reachable, kept is that of the
    document which stands for its class. Null and empty texts have fingerprint
    zero and are linked like any other. Rows that repeat an id share its class.
    A null id is no class's id (component_id is null where no row of a class
    has one) and is not kept. An empty table gives an empty result; other
    columns are not looked at.
    """
    docs_fp = ship.checkpointed(fingerprints(docs, id_col, text_col, shingle))
    named = _labelled(docs_fp, max_bits, blocks)
    named = named.join(named.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("fp", "component_id")
    out = docs_fp.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row of each class of near-duplicates, with the columns it had: that of the smallest id (null ids last).

    Rows are known by two 64-bit hashes of all their columns, so that of rows
    that repeat, whatever their ids, one stays. Equal rows are brought together
    before they are moved. An empty table gives an empty result.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    whole = [*cols, *[c.isNull() for c in cols]]
    keys = [F.xxhash64(*whole).alias("h1"), F.xxhash64(F.lit(1), *whole).alias("h2")]
    named = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *keys).alias("id"), F.col(text_col).alias("text"))
    labelled = _labelled(ship.checkpointed(fingerprints(named, "id", "text", shingle)), max_bits, blocks)
    stays = labelled.groupBy("label").agg(F.min("first").alias("id")).select("id.h1", "id.h2")
    rows = docs.select(F.struct(*cols).alias("row"), *keys).dropDuplicates(["h1", "h2"])
    return rows.join(stays, ["h1", "h2"], "left_semi").select("row.*")
