"""Spelling variants: words one error apart, by forward and backward minimal acyclic automata.

If two words differ by one inserted, deleted or replaced code point, half of
the longer one is in the other exactly: its first half at the front, or its
second half at the end. So every word is dealt to the groups of its halves,
for its own length and for that of a word one longer; a group's words make a
minimal automaton (of reversed words for the second halves) whose states count
the words behind them, so that a path ends in the number of its word. Each word
of the group's own length walks its half exactly and completes the rest with
one error. A pair that both directions find is taken from the forward one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship
from .groups import parted

#: Code points of a word at least, its occurrences, and how much more frequent a form is.
MIN_LENGTH, MIN_COUNT, TIMES = 7, 2, 10
#: One run of letters in so many loses a code point.
DAMAGED = 31
RUNS = f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}"
#: Distinct words that a counting task holds before it sends their counts.
HELD_WORDS = 400_000
#: Words of a group that one automaton may have, of small groups together too, and rows that a task should have.
GROUP_WORDS, TASK_ROWS = 50_000, 100_000


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a path to a word adds up to its number."""

    def __init__(self, words):
        self.edges: list[dict[str, tuple[int, int]]] = []  # state -> letter -> (words before that branch, next state)
        self.final: list[bool] = []
        self.size: list[int] = []  # words that can be completed from the state
        known: dict[tuple, int] = {}
        path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]  # the last word's states, not yet merged
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, out = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(final, out, known)))

        for w in words:
            k = 0
            for a, b in zip(w, last, strict=False):
                if a != b:
                    break
                k += 1
            close(k)
            path += [(False, []) for _ in range(len(w) - k)]
            path[-1] = (True, path[-1][1])
            last = w
        close(0)
        self.root = self._state(*path[0], known)

    def _state(self, final: bool, out: list[tuple[str, int]], known: dict) -> int:
        key = (final, *out)
        at = known.get(key)
        if at is None:
            at = known[key] = len(self.edges)
            edges, n = {}, int(final)
            for c, to in out:
                edges[c] = (n, to)
                n += self.size[to]
            self.edges.append(edges)
            self.final.append(final)
            self.size.append(n)
        return at

    def walk(self, state: int, number: int, letters: str) -> tuple[int, int]:
        """State and number after the letters, or (-1, 0)."""
        edges = self.edges
        for c in letters:
            step = edges[state].get(c)
            if step is None:
                return -1, 0
            number += step[0]
            state = step[1]
        return state, number

    def one_error(self, word: str, half: int):
        """(number, replaced) of each word that has the first ``half`` letters of ``word`` and, after them, one letter replaced or left out."""
        state, number = self.walk(self.root, 0, word[:half])
        if state < 0:
            return
        edges, final, walk = self.edges, self.final, self.walk
        for i in range(half, len(word)):
            c, rest = word[i], word[i + 1 :]
            if i == half or c != word[i - 1]:  # of a run of one letter the first is left out
                end, found = walk(state, number, rest)
                if end >= 0 and final[end]:
                    yield found, False
            for other, (before, to) in edges[state].items():
                if other != c:
                    end, found = walk(to, number + before, rest)
                    if end >= 0 and final[end]:
                        yield found, True
            step = edges[state].get(c)
            if step is None:
                return
            state, number = step[1], number + step[0]


def damaged(doc: str, run: str, seed: int | None = None) -> str:
    """A lower-case run as it counts in a document: some lose a code point, by the crc32 of ``doc``:``run``."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc}:".encode()) if seed is None else seed)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches):
    find = re.compile(RUNS).findall

    def sent(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for b in batches:
        for doc, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
            seed = zlib.crc32(f"{doc}:".encode())
            for run, n in Counter(find(text.as_py().lower().decode("utf-8", "replace"))).items():  # bytes: only A-Z become lower case
                word = damaged(doc, run, seed)
                if len(word) >= MIN_LENGTH:
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield sent(held)
                held.clear()
    if held:
        yield sent(held)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of at least MIN_LENGTH code points, with their occurrences in all texts, MIN_COUNT at least."""
    ship.ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _half(length: int, forward: bool) -> int:
    return length // 2 if forward else length - length // 2


def _chunks(batches, most: int):
    """Rows sorted by (forward, length, p, q, spelled), as lists that end where a group does; groups are gathered to about ``most`` rows."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("forward", "length", "p", "q", "spelled", "part", "n")), strict=True):
            if held:
                last, half = held[-1], _half(r[1], r[0])
                if r[:4] != last[:4] or (len(held) >= most and r[4][:half] != last[4][:half]):
                    yield held
                    held = []
            held.append(r)
    if held:
        yield held


def _near(batches):
    """word, near, near_n: one row for each direction of each pair found."""
    out: list[tuple] = []

    def sent():
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["word", "near", "near_n"])

    for rows in _chunks(batches, GROUP_WORDS):
        forward, length, p, q = rows[0][:4]
        half, front = _half(length, forward), length // 2
        automaton = Automaton([r[4] for r in rows])
        for _, _, _, _, spelled, part, n in rows:
            if len(spelled) != length:
                continue  # only there to be found
            for number, replaced in automaton.one_error(spelled, half):
                _, _, _, _, other, other_part, m = rows[number]
                if p != q and part == other_part:
                    continue  # met in that part's own cell
                a, b = (spelled, other) if forward else (spelled[::-1], other[::-1])
                if replaced:
                    out.append((a, b, m))  # the other word finds this one
                elif forward or a[:front] != b[:front]:
                    out += [(a, b, m), (b, a, n)]
        if len(out) > 20_000:
            yield sent()
            out.clear()
    if out:
        yield sent()


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: each ordered pair of words that differ by exactly one code point inserted, deleted or replaced, once.

    ``words`` has distinct words and n. A group over GROUP_WORDS words is cut
    into parts, and every two parts meet in a task of their own.
    """
    spark = words.sparkSession
    ship.ship(spark)
    length = F.length("word")
    roles = F.explode(F.array(*[F.struct(F.lit(f).alias("forward"), (length + k).alias("length")) for f in (True, False) for k in (0, 1)]))
    dealt = words.select("word", "n", roles.alias("r")).select("word", "n", "r.*", F.when(F.col("r.forward"), F.col("word")).otherwise(F.reverse("word")).alias("spelled"))
    front = F.floor(F.col("length") / 2).cast("int")
    half = F.substring("spelled", F.lit(1), F.when(F.col("forward"), front).otherwise(F.col("length") - front))
    dealt = dealt.select("n", "forward", "length", "spelled", F.concat_ws(":", F.col("forward").cast("string"), F.col("length").cast("string"), half).alias("key"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-4 * words.count() // TASK_ROWS))
    dealt = parted(dealt, "key", "spelled", GROUP_WORDS).select("forward", "length", "p", "q", "spelled", "part", "n", "key")
    order = ["forward", "length", "p", "q", "spelled"]
    return dealt.repartition(tasks, "key", "p", "q").sortWithinPartitions(*order).select(*order, "part", "n").mapInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of each row (word, form), by following forms to the last; forms are more frequent each time, so there are no rings.

    Each round doubles the steps that are taken; chains are as long as a count
    can be multiplied by TIMES, at most.
    """
    at = ship.checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = ship.checkpointed(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word: word, n, n_near (words one error away), form, form_n, root.

    Words are runs of letters of whole texts, A-Z in lower case, of which
    ``damaged`` shortens some. A word's form is the most frequent near word
    (of equal ones the first in code-point order) if it occurs TIMES as often;
    root is where forms lead. A null text has no words; a null id counts as
    an empty one; repeated rows count again; an empty table gives an empty
    result; other columns are not looked at.
    """
    words = ship.checkpointed(word_counts(docs, id_col, text_col))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", F.when(-F.col("best.n") >= TIMES * F.col("n"), -F.col("best.n")))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n")
    found = ship.checkpointed(found)
    last = roots(found.where("form is not null").select("word", "form"))
    return found.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
