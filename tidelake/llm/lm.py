"""Language-model scores of whole texts by deleted interpolation of word bigrams.

P(w | h) = a c(h, w) / c(h) + b c(w) / N + c / (V + 1), with one triple of
mixture weights for each bucket of the context's frequency c(h) (powers of
two). The weights are learned by expectation-maximisation on a held-out tenth
of the training texts with the counts of the rest; scores then use the counts
of all training texts.

Texts are read once into blocks of encoded tokens. Each block asks for the
counts of its distinct words and bigrams: keys go to the range of hashes that
they belong to, sums come back. There are as many ranges as keep RANGE_KEYS keys in
one task, so a message from a block to a range holds RANGE_KEYS / blocks keys. So a word that is in every text crosses the
network once for each block, no count table is ever broadcast, and nothing
but sums over frequency classes reaches the driver. Words and bigrams are known
by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ship

#: Tokens of a block, and keys (of all blocks together) that a range of hashes should have: what a task holds decoded at once.
BLOCK_TOKENS, RANGE_KEYS = 1_000_000, 8_000_000
END = 0  # the end token's hash; no word has it
BUCKETS = 40
#: Frequencies are told apart to a part of an octave when weights are learned.
PER_OCTAVE = 8
ROUNDS = 40
_CODEC = "zstd"


def pack(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return a.dtype.str.encode()[1:3] + len(a).to_bytes(8, "little") + pa.compress(planes, _CODEC, asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    kind, n = np.dtype("<" + b[:2].decode()), int.from_bytes(b[2:10], "little")
    raw = np.frombuffer(pa.decompress(b[10:], n * kind.itemsize, _CODEC, asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel()


def pack_counts(keys: np.ndarray, train: np.ndarray, tune: np.ndarray) -> bytes:
    """Sorted keys and their counts as one compressed frame: differences and counts by byte planes."""
    delta = np.diff(keys, prepend=keys.dtype.type(0))
    planes = b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in (delta, train.astype("<u4"), tune.astype("<u4")))
    return len(keys).to_bytes(4, "little") + pa.compress(planes, _CODEC, asbytes=True)


def unpack_counts(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(b[:4], "little")
    raw = np.frombuffer(pa.decompress(b[4:], n * 16, _CODEC, asbytes=True), np.uint8)
    part = lambda i, j, kind: np.ascontiguousarray(raw[i * n : j * n].reshape(j - i, n).T).view(kind).ravel()
    return np.cumsum(part(0, 8, "<u8"), dtype=np.uint64), part(8, 12, "<u4"), part(12, 16, "<u4")


def range_bits(keys: int) -> int:
    """Bits of a hash that tell ranges apart, for so many keys of all blocks."""
    return max(4, (max(0, keys - 1) // RANGE_KEYS).bit_length())


def mix64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of ordered pairs of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


def _encode_blocks(batches):
    """Blocks of texts: distinct word hashes, and each token as a place among them."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0

    def fresh():
        return {None: 0}, [], [], [], [], 0

    words, ids, lens, flags, toks, n = fresh()

    def row():
        hashes = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w) or 1 for w in words), np.uint64, len(words))
        cols = [pack(hashes), pack(np.concatenate(toks)), pack(np.array(ids, np.int64)), pack(np.array(lens, np.int64)), pack(np.array(flags, np.uint8))]
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | made]), pa.array([len(words) + n], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], ["block", "keys", "words", "tokens", "ids", "lens", "flags"])

    for b in batches:
        for i, text, train, tune in zip(b.column("id").to_pylist(), b.column("text"), b.column("train").to_pylist(), b.column("tune").to_pylist(), strict=True):
            found = text.as_py().encode("utf-8", "replace").lower().split()
            new = len(words)
            at = list(map(words.get, found))
            if None in at:
                for k, w in enumerate(found):
                    if at[k] is None:
                        p = words.get(w)
                        if p is None:
                            p = words[w] = new
                            new += 1
                        at[k] = p
            at.append(0)
            ids.append(0 if i is None else i)
            lens.append(len(at))
            flags.append(train + 2 * (train and tune) + 4 * (i is None))
            toks.append(np.array(at, np.uint32))
            n += len(at)
            if n >= BLOCK_TOKENS:
                yield row()
                made += 1
                words, ids, lens, flags, toks, n = fresh()
    if ids:
        yield row()


class _Block:
    """A decoded block: keys of its tokens and their distinct, sorted keys of both kinds."""

    def __init__(self, words: bytes, tokens: bytes, lens: bytes, flags: bytes):
        hashes, self.tok = unpack(words), unpack(tokens)
        self.lens, self.flags = unpack(lens), unpack(flags)
        first = np.cumsum(np.r_[0, self.lens[:-1]])
        before = np.r_[np.uint32(0), self.tok[:-1]]
        before[first] = 0
        self.before = before
        self.flag = np.repeat(self.flags, self.lens)
        self.uni, inv = np.unique(hashes, return_inverse=True)
        self.word_at = inv  # word -> place in uni
        self.bi, self.bi_first, self.bi_at = np.unique(mix64(hashes[before], hashes[self.tok]), return_index=True, return_inverse=True)

    def counts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For words and for bigrams: keys, counts in training texts, counts in those to tune on."""
        train, tune = (self.flag & 1).astype(bool), (self.flag & 2).astype(bool)
        out = []
        for keys, at in ((self.uni, self.word_at[self.tok]), (self.bi, self.bi_at)):
            out.append((keys, np.bincount(at[train], minlength=len(keys)).astype(np.uint32), np.bincount(at[tune], minlength=len(keys)).astype(np.uint32)))
        return out


def _release() -> None:
    """Give back what Arrow's allocator keeps of freed buffers: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()


def _requests(bits: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = []
                for kind, (keys, train, tune) in enumerate(_Block(r["words"], r["tokens"], r["lens"], r["flags"]).counts()):
                    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() + [len(keys)]
                    for i, j in zip(cuts, cuts[1:], strict=False):
                        rows.append((kind << bits | int(part[i]), r["block"], pack_counts(keys[i:j], train[i:j], tune[i:j])))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["part", "block", "asked"])
                del rows, cols
                _release()

    return run


def _sum_part(table: pa.Table) -> pa.Table:
    """Counts of one range of hashes over all blocks, and each block's answer."""
    keys, train, tune = zip(*(unpack_counts(x.as_py()) for x in table.column("asked")), strict=True)
    cuts = np.cumsum([0, *map(len, keys)])
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    total = np.bincount(at, np.concatenate(train), len(every)).astype(np.uint64)
    tuned = np.bincount(at, np.concatenate(tune), len(every)).astype(np.uint64)
    del train, tune
    answer = [(pack(total[at[i:j]]), pack(tuned[at[i:j]])) for i, j in zip(cuts, cuts[1:], strict=False)]
    del at
    _release()
    n = table.num_rows
    sums = [(int(total.sum()), int((total > 0).sum()), int((total - tuned).sum()), int((total > tuned).sum()))] + [(0, 0, 0, 0)] * (n - 1)
    cols = {"block": table.column("block"), "part": table.column("part"), "train": pa.array([a[0] for a in answer], pa.binary()), "tune": pa.array([a[1] for a in answer], pa.binary())}
    return pa.table(cols | {k: pa.array([s[i] for s in sums], pa.int64()) for i, k in enumerate(("n", "v", "n_rest", "v_rest"))})


def _answered(n_rest: int):
    """A block's texts with each token as a place in a table of counts (c(h,w), c(h), c(w)), and its events to tune on.

    The events are summed by bucket and rounded logarithms of both estimates
    from the texts that are not tuned on (n_rest tokens).
    """

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        got = [np.concatenate([unpack(x.as_py()) for x in answers.column(c)]) for c in ("train", "tune")]
        out = []
        for r in block.to_pylist():
            b = _Block(r["words"], r["tokens"], r["lens"], r["flags"])
            cut = len(b.uni)
            # one row of counts for each distinct bigram, then for each distinct row; rows are told apart by a hash
            h, w = b.before[b.bi_first], b.tok[b.bi_first]
            every, tuned = ([g[cut:], (u := g[:cut][b.word_at])[h], u[w]] for g in got)
            freq = np.bincount(b.bi_at[(b.flag & 2) > 0], minlength=len(b.bi))
            some = freq > 0
            events = _events(*((a[some] - t[some]).astype(np.int64) for a, t in zip(every, tuned, strict=True)), freq[some], n_rest)
            _, first, at = np.unique(mix64(mix64(every[0], every[1]), every[2]), return_index=True, return_inverse=True)
            at = at[b.bi_at]
            order = np.argsort(-np.bincount(at, minlength=len(first)), kind="stable")
            place = np.empty(len(first), np.uint32)
            place[order] = np.arange(len(first), dtype=np.uint32)
            table = np.stack([x[first][order] for x in every])
            out.append((pack(table.ravel()), pack(place[at]), r["ids"], r["lens"], r["flags"], pack(events.ravel())))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        _release()
        return pa.table({k: pa.array(c, pa.binary()) for k, c in zip(("counts", "tokens", "ids", "lens", "flags", "events"), cols, strict=True)})

    return run


def _events(two, ctx, one, freq, n: int) -> np.ndarray:
    """Rows (bucket, rounded log of c(h,w)/c(h), of c(w)/n, events)."""
    q2 = np.where(two > 0, np.rint(np.log2(np.maximum(two, 1) / np.maximum(ctx, 1)) * PER_OCTAVE), -9999).astype(np.int64)
    q1 = np.where(one > 0, np.rint(np.log2(np.maximum(one, 1) / max(n, 1)) * PER_OCTAVE), -9999).astype(np.int64)
    key, at = np.unique(np.stack([bucket(ctx), q2, q1], axis=1), axis=0, return_inverse=True)
    return np.concatenate([key, np.bincount(at.ravel(), freq, len(key)).astype(np.int64)[:, None]], axis=1)


def bucket(c: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0 if unseen, else 1 + log2."""
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, 0), BUCKETS - 1)


def _tuning(batches):
    for b in batches:
        for x in b.column("events").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in unpack(x).reshape(-1, 4).T], ["bucket", "q2", "q1", "n"])


def learn_weights(rows: pa.Table, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bucket; bigram, word, uniform) by expectation-maximisation."""
    w = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    w[0] = [0, 0.9, 0.1]
    if not rows.num_rows:
        return w
    rows = rows.sort_by([(c, "ascending") for c in ("bucket", "q2", "q1")])
    b, q2, q1, n = (rows.column(c).to_numpy() for c in ("bucket", "q2", "q1", "n"))
    p = np.stack([np.where(q2 > -9999, 2.0 ** (q2 / PER_OCTAVE), 0), np.where(q1 > -9999, 2.0 ** (q1 / PER_OCTAVE), 0), np.full(len(n), 1 / (v + 1))], axis=1)
    for _ in range(rounds):
        share = w[b] * p
        share *= (n / share.sum(axis=1))[:, None]
        # one event of the start weights keeps every weight above zero
        total = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], axis=1) + [[0.1, 0.5, 0.4]]
        total[0, 0] = 0
        w = total / total.sum(axis=1, keepdims=True)
    return w


def _scores(n: int, v: int, weights: np.ndarray):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                two, ctx, one = unpack(r["counts"]).reshape(3, -1).astype(np.float64)
                w = weights[bucket(ctx)]
                p = w[:, 0] * two / np.maximum(ctx, 1) + w[:, 1] * one / max(n, 1) + w[:, 2] / (v + 1)
                base = np.log10((one + 0.5) / (n + 0.5 * (v + 1)))
                tok, lens = unpack(r["tokens"]), unpack(r["lens"])
                first = np.cumsum(np.r_[0, lens[:-1]])
                sums = [np.add.reduceat(x[tok], first) for x in ((one > 0).astype(np.int64), base, np.log10(p))]
                ids = pa.array(unpack(r["ids"]), mask=(unpack(r["flags"]) & 4) > 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(lens), *(pa.array(x) for x in sums)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train: Column, tune: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, n_known, train_tokens, base_score, score (log10) of every whole text.

    ``train`` tells which rows to learn from, ``tune`` which of those to hold
    out for the mixture weights. Tokens are words in lower case (A-Z) and one
    end for each text. base_score is that of single words with half a count
    added. A null text is empty: one end token. Ids are integers, a null one
    stays null; repeated rows are each counted and scored; an empty table gives an empty
    result; other columns are not looked at. With nothing to learn from, every
    word has the uniform probability.
    """
    spark = docs.sparkSession
    ship.ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), flag(train).alias("train"), flag(tune).alias("tune"))
    kept = ship.Bucketed(rows.mapInArrow(_encode_blocks, "block long, keys long, words binary, tokens binary, ids binary, lens binary, flags binary"), "lm-blocks", "block", docs)
    p2 = None
    try:
        blocks = kept.rows
        bits = range_bits(blocks.agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0])
        asked = blocks.select("block", "words", "tokens", "lens", "flags").mapInArrow(_requests(bits), "part long, block long, asked binary")
        summed = asked.groupBy("part").applyInArrow(_sum_part, "block long, part long, train binary, tune binary, n long, v long, n_rest long, v_rest long")
        answers, p2 = ship.written(summed, "lm-answers")
        size = answers.where(F.col("part") < 1 << bits).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_rest", "v_rest")]).first()
        back = answers.select("block", "part", "train", "tune")
        texts = blocks.select("block", "words", "tokens", "ids", "lens", "flags")
        done = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_answered(size.n_rest), "counts binary, tokens binary, ids binary, lens binary, flags binary, events binary")
        coded, _ = ship.written(done, "lm-coded")
    finally:  # nothing of a failed run stays in the catalog or the folder
        kept.remove()
        if p2:
            ship.removed(spark, p2)
    classes = coded.select("events").mapInArrow(_tuning, "bucket long, q2 long, q1 long, n long")
    weights = learn_weights(classes.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toArrow(), size.v_rest)  # frequency classes: bounded by the rounding
    out = coded.select("counts", "tokens", "ids", "lens", "flags").mapInArrow(_scores(size.n, size.v, weights), "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_tokens", "n_known", F.lit(size.n).cast("long").alias("train_tokens"), "base_score", "score")
