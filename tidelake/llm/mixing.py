"""Mixing sources to target weights with DataFrame functions only.

Source shares of tokens are raised to an exponent and normalised. The exponent
is searched by sections (each step evaluates SECTIONS exponents in one
aggregation over the sources) for the flattest mix whose entropy and whose
largest number of passes over a source stay within their limits. Weights times
the token budget are quotas; a quota is met by whole passes over the source
and the front part of one permutation of it. The permutation is the order of a
hash of the ids; its leading digits deal it into blocks, so that the place
where a quota is used up is found from sums per block and from the rows of one
block of each source, however many rows a source has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ship import checkpointed

SECTIONS, STEPS = 16, 8
#: Rows of a block of the permutation, about.
BLOCK_ROWS = 4096
#: Sources whose table is broadcast, at most.
MAX_SENT = 50_000
ENTROPY, MAX_PASSES, SEED = 0.97, 4.0, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def _source(col: str) -> Column:
    """A source's key; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(col).cast("string")), F.lit("n"))


def _place(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def solve_exponent(sources: DataFrame, n: int, total: int, low_share: float, budget: float, entropy: float, max_passes: float) -> float:
    """The smallest exponent in [0, 1] that keeps to both limits, else 1. sources: ``share`` per source, above zero.

    Fewer than two sources need none: 1. Equal shares tie, and any exponent
    gives the same weights.
    """
    if n < 2:
        return 1.0
    most = entropy * math.log(n)

    def fits(a: float, z: float, s: float) -> bool:
        # s: sum of share^a ln share. The source of the smallest share is repeated most.
        return math.log(z) - a * s / z <= most + 1e-12 and budget / total * math.exp((a - 1) * low_share) / z <= max_passes + 1e-12

    lo, hi = 0.0, 1.0
    log = F.ln("share")
    for step in range(STEPS):
        grid = [lo + (hi - lo) * k / (SECTIONS + 1) for k in range(0 if step == 0 else 1, SECTIONS + 1)]
        power = [F.exp(log * a) for a in grid]
        row = sources.agg(*[F.sum(p).alias(f"z{i}") for i, p in enumerate(power)], *[F.sum(p * log).alias(f"s{i}") for i, p in enumerate(power)]).first()
        good = [fits(a, row[f"z{i}"], row[f"s{i}"]) for i, a in enumerate(grid)]
        if good[0] and step == 0:
            return 0.0
        k = good.index(True) if any(good) else len(grid)
        lo, hi = (grid[k - 1] if k else lo), (grid[k] if k < len(grid) else hi)
    return hi


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget_ratio: float = 1.0, entropy: float = ENTROPY, max_passes: float = MAX_PASSES, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Rows (``id``, ``source_key``, ``tokens``, ``place``) and, per source, passes and where the last one ends.

    Tokens are words. entropy is a fraction of the entropy of equal weights
    that the mix must not exceed (a corpus that exceeds it already keeps its
    shares); max_passes bounds quota / tokens of every source.
    """
    base = docs.select(F.col(id_col).alias("id"), _source(source_col).alias("source_key"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"), _place(id_col, seed).alias("place"))
    base = checkpointed(base)
    size = base.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    digits = max(1, math.ceil(math.log(max(1, size.n / BLOCK_ROWS), 16)))
    blocks = checkpointed(base.groupBy("source_key", F.substring("place", 1, digits).alias("block")).agg(F.sum("tokens").alias("tokens")))
    per = blocks.groupBy("source_key").agg(F.sum("tokens").alias("source_tokens"))
    per = checkpointed(per.withColumn("share", F.when(F.col("source_tokens") > 0, F.col("source_tokens") / F.lit(size.t or 1))))
    some = per.where("share > 0")
    known = some.agg(F.count("*").alias("n"), F.min(F.ln("share")).alias("low")).first()
    budget = budget_ratio * (size.t or 0)
    a = solve_exponent(some, known.n, size.t or 1, known.low or 0.0, budget, entropy, max_passes)
    z = (some.agg(F.sum(F.exp(F.ln("share") * a))).first()[0]) or 1.0
    weight = F.coalesce(F.exp(F.ln("share") * a) / z, F.lit(0.0))
    quota = F.floor(F.round(weight * budget, 3) + 0.5).cast("long")
    per = per.select("source_key", "source_tokens", weight.alias("weight"), quota.alias("quota"))
    per = per.select("*", F.when(F.col("source_tokens") > 0, F.floor(F.col("quota") / F.col("source_tokens"))).otherwise(0).cast("long").alias("passes"))
    per = per.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_tokens"))
    before = F.sum("tokens").over(Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    runs = blocks.withColumn("before", F.coalesce(before, F.lit(0))).join(per.select("source_key", "rest"), "source_key")
    last = runs.where("before <= rest AND before + tokens > rest").groupBy("source_key", "rest").agg(F.min_by(F.struct("block", "before"), "block").alias("b")).select("source_key", "rest", "b.block", "b.before")
    rows = base.withColumn("block", F.substring("place", 1, digits)).join(last, ["source_key", "block"])
    so_far = F.col("before") + F.sum("tokens").over(Window.partitionBy("source_key", "block").orderBy("place", "tokens"))
    cut = rows.withColumn("so_far", so_far).groupBy("source_key", "block").agg(F.max(F.when(F.col("so_far") <= F.col("rest"), F.col("place"))).alias("cut"))
    cut = cut.select("source_key", F.coalesce("cut", "block").alias("cut"))
    return base, checkpointed(per.join(cut, "source_key", "left").select("source_key", "weight", "quota", "passes", F.coalesce("cut", F.lit("")).alias("cut")))


def copies(docs: DataFrame, per: DataFrame) -> DataFrame:
    """Rows with the number of times each is taken; docs: ``source_key``, ``place``. Rows of one place are taken equally often; no rows give none.

    The table of sources is sent to all tasks if it has few rows, so that a
    source with a third of all rows is not dealt to one; else it is joined by key.
    """
    few = per.limit(MAX_SENT + 1).count() <= MAX_SENT
    return docs.join(F.broadcast(per) if few else per, "source_key").withColumn("copies", F.col("passes") + (F.col("place") <= F.col("cut")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The documents as often as the mix takes them, with the columns they had.

    A null source is a source of its own; a null text has no tokens. A source
    without tokens gets no quota. An empty table gives an empty result. Rows
    that repeat an id are taken equally often.
    """
    _, per = plan(docs, id_col, source_col, text_col, **limits)
    dealt = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _source(source_col).alias("source_key"), _place(id_col, limits.get("seed", SEED)).alias("place"))
    taken = copies(dealt, per).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """One row per document: ``id_col``, tokens, weight and quota of its source, copies (how often it is taken)."""
    base, per = plan(docs, id_col, source_col, text_col, **limits)
    return copies(base, per).select(F.col("id").alias(id_col), "tokens", F.round("weight", 6).alias("weight"), "quota", "copies")
