"""What each of five document filters removes, in every order in which they can be applied.

A document fails some of the filters: a mask of five bits. The step at which
an order removes it is the place of the first filter of that order that it
fails, read from a table of 32 masks by 120 orders. Tasks read the table for
the masks of their rows, add up removals by part, order, step and label, and
send one array a part; the arrays are summed.

Whether a text repeats is known by its 128-bit digest. Rows are first dealt by
id (which also brings the labels), then texts that are equal are summed before
they are dealt by digest: a text that a third of all documents share is a row a
task by then.
"""

from __future__ import annotations

import hashlib
import itertools
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ship

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
# The filters' limits.
MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent of the words
MAX_CAPITALS = 3  # per cent of the code points
SYMBOLS = "#$%&*|"
#: Parts whose arrays a task holds before it sends them.
HELD_PARTS = 500

_LATER = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point
_CAPITALS = string.ascii_uppercase.encode()


def first_failures() -> np.ndarray:
    """Step (0 to 4) at which each order (column) removes a document with each mask (row); 5 if none does."""
    fails = (np.arange(32)[:, None] >> np.arange(5)) & 1
    order = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    seen = fails[:, order] > 0  # mask, order, step
    return np.where(seen.any(axis=2), seen.argmax(axis=2), 5)


def own_failures(text: bytes) -> int:
    """The bits of filters A to D that a text fails."""
    words = text.split()  # bytes split at space and \\x09-\\x0D only
    few = len(words) < MIN_WORDS
    dull = 100 * len(set(words)) < MIN_DISTINCT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > MAX_CAPITALS * len(text.translate(None, _LATER))
    marked = len(text.translate(None, SYMBOLS.encode())) < len(text)
    return few | dull << 1 | loud << 2 | marked << 3


def _judge(batches):
    """Mask and digest of each row; rows without an id are numbered, so that they don't meet in one task."""
    seen = 0
    for b in batches:
        texts = [x.as_py() for x in b.column("text")]
        mask = pa.array([own_failures(t) for t in texts], pa.int32())
        digest = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
        spread = np.where(b.column("id").is_null().to_numpy(zero_copy_only=False), np.arange(seen, seen + len(texts)), 0)
        seen += len(texts)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spread, pa.int64()), b.column("part"), mask, digest], ["id", "spread", "part", "mask", "digest"])


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each mask: step at which each order removes it; and, laid out as order and step, whether that step's filter fails, and fails alone."""
    order = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    mask = np.arange(32)
    fails = ((mask[:, None, None] >> order[None]) & 1).reshape(32, -1)
    alone = (mask[:, None, None] == (1 << order)[None]).reshape(32, -1)
    return first_failures(), fails.astype(np.int64), alone.astype(np.int64)


def _tally(batches):
    """One row a part and task: the seven measures of every order and step, one after another."""
    steps, fails, alone = _tables()
    letter = np.array([[FILTERS.index(f) for f in o] for o in ORDERS]).ravel()
    places = np.arange(len(ORDERS)) * 6

    def measured(counts: np.ndarray) -> list[int]:
        """From counts by label (quality 1, toxic 1) and mask."""
        at = (places + steps).ravel()  # mask, order -> place of the removal
        every, good, toxic = counts.sum(axis=0), counts[1] + counts[3], counts[2] + counts[3]
        gone = [np.bincount(at, np.repeat(c, len(ORDERS)), len(ORDERS) * 6).reshape(-1, 6)[:, :5].astype(np.int64) for c in (every, good, toxic)]
        removed = gone[0].ravel()
        kept = every.sum() - np.cumsum(gone[0], axis=1).ravel()
        shapley = np.bincount(letter, removed, 5).astype(np.int64)[letter]
        return np.concatenate([kept, removed, every @ fails - removed, every @ alone, gone[1].ravel(), gone[2].ravel(), shapley]).tolist()

    def sent(held):
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([measured(c) for c in held.values()], pa.list_(pa.int64()))], ["part", "sums"])

    held: dict[str, np.ndarray] = {}
    for b in batches:
        names = b.column("part").dictionary_encode()
        label = b.column("good").to_numpy() + 2 * b.column("toxic").to_numpy()
        code = (names.indices.to_numpy().astype(np.int64) * 4 + label) * 32 + b.column("mask").to_numpy()
        counts = np.bincount(code, b.column("n").to_numpy(), len(names.dictionary) * 128).astype(np.int64).reshape(-1, 4, 32)
        for part, c in zip(names.dictionary.to_pylist(), counts, strict=True):
            held[part] = held[part] + c if part in held else c
        if len(held) > HELD_PARTS:
            yield from sent(held)
            held = {}
    if held:
        yield from sent(held)


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", label_id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, mask (filters failed, A is bit 0), good, toxic (0 or 1), n: numbers of documents, not yet one row a combination.

    See ``audit`` for nulls, repeats and empty tables.
    """
    ship.ship(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    judged = rows.mapInArrow(_judge, f"id {kind}, spread long, part string, mask int, digest binary")
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.where(F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).alias("lid")).agg(is_one(good_col).alias("good"), is_one(toxic_col).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    key = (F.col("id") == F.col("lid")) & (F.col("spread") == F.col("lspread"))
    named = judged.join(known.withColumn("lspread", F.lit(0).cast("long")), key, "left").select("id", "spread", "part", "mask", "digest", flag("good"), flag("toxic"))
    kinds = ["digest", "mask", "part", "good", "toxic"]
    # rows of one id are together from the join on; equal texts are summed before they are dealt by digest
    each = named.groupBy("id", "spread", *kinds).agg(F.count("*").alias("n"))
    nameless = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    same = each.groupBy(*kinds).agg(F.min("id").alias("first"), F.sum("n").alias("n"), F.min_by("n", "id").alias("n_first"), nameless.alias("nameless"))
    same = same.withColumn("smallest", F.min("first").over(Window.partitionBy("digest")))
    passed = F.col("nameless") + F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), passed.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passed).alias("n"))))
    return same.select("part", "good", "toxic", split.alias("x")).select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step (1 to 5) and the seven measures: 600 rows for each part, zeros included.

    Parts are values of ``part_col`` (null: the empty string). A null text is
    empty: it fails A and no other of the first four. E is failed by every row
    whose text a row with a smaller id has; rows that repeat the smallest id
    don't fail it, nor do rows with a null id, which count as copies of none.
    Documents without a label are neither good nor toxic; of several labels of
    one id any that is 1 counts. No documents give no rows; other columns,
    whatever their names, are not looked at. Column names: see ``failures``.
    """
    sums = failures(docs, labels, **columns).mapInArrow(_tally, "part string, sums array<long>")
    summed = sums.select("part", F.posexplode("sums").alias("at", "x")).groupBy("part", "at").agg(F.sum("x").alias("x"))
    cells = len(ORDERS) * 5
    wide = summed.groupBy("part", (F.col("at") % cells).alias("cell")).agg(*[F.sum(F.when(F.floor(F.col("at") / cells) == i, F.col("x"))).cast("long").alias(m) for i, m in enumerate(MEASURES)])
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.floor(F.col("cell") / 5) + 1).cast("int"))
    return wide.select("part", order.alias("filter_order"), (F.col("cell") % 5 + 1).cast("int").alias("step"), *MEASURES)
