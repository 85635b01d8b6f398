"""Rank-synchronous merging of byte-pair encodings over ragged numpy arrays.

Many sequences of symbols lie in one flat array. In each round every sequence
applies its pair of lowest rank, all of them at once. A sequence applies as
many copies of that pair as the sequential algorithm (lowest rank, then
leftmost) would apply before it turned to another pair, so the result is the
same as one merge at a time.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)


class PairTable:
    """Symbol pairs -> rank and merged symbol, looked up for whole arrays by binary search."""

    def __init__(self, left, right, rank, merged):
        key = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.key = np.append(key[order], np.int64(2**62))
        self.rank = np.append(np.asarray(rank, np.int32)[order], NONE)
        self.merged = np.append(np.asarray(merged, np.int32)[order], 0)

    def find(self, left, right):
        """Positions in the table, or its last (rank NONE) where there is no such pair."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.searchsorted(self.key[:-1], key)
        return np.where(self.key[at] == key, at, len(self.key) - 1)


def merge_batch(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge sequences laid out one after another; returns the symbols left and the lengths left."""
    symbols, lengths = np.asarray(symbols, np.int32), np.asarray(lengths, np.int64)
    n_seq = len(lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # (sequence of each symbol, symbols), both of finished sequences
    seq = np.repeat(np.arange(n_seq), lengths)
    sym = symbols
    pair = _pairs(sym, seq, table)
    while len(sym):
        rank = table.rank[pair]
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        low = np.minimum.reduceat(rank, first)
        spans = np.diff(np.r_[first, len(sym)])
        live = low < NONE
        if not live.all():
            stay = np.repeat(live, spans)
            done.append((seq[~stay], sym[~stay]))
            sym, seq, pair, rank = sym[stay], seq[stay], pair[stay], rank[stay]
            if not len(sym):
                break
            low, spans = low[live], spans[live]
        slot = np.repeat(np.arange(len(low)), spans)
        at = _apart(np.flatnonzero(rank == low[slot]))
        at = _sequential(at, sym, seq, pair, slot, low, table)
        sym = sym.copy()
        sym[at] = table.merged[pair[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1  # new places
        touched = moved[at]
        sym, seq, pair = sym[keep], seq[keep], pair[keep]
        mark = np.zeros(len(sym), bool)
        mark[touched] = True
        mark[touched[touched > 0] - 1] = True
        touched = np.flatnonzero(mark)
        pair[touched] = _pairs_at(touched, sym, seq, table)
    if not done:
        return symbols[:0], np.zeros(n_seq, np.int64)
    seq = np.concatenate([s for s, _ in done])
    sym = np.concatenate([s for _, s in done])
    order = np.argsort(seq, kind="stable")
    return sym[order], np.bincount(seq, minlength=n_seq)


def _pairs_at(at, sym, seq, table):
    nxt = np.minimum(at + 1, len(sym) - 1)
    found = table.find(sym[at], sym[nxt])
    return np.where((nxt > at) & (seq[nxt] == seq[at]), found, len(table.key) - 1)


def _pairs(sym, seq, table):
    return _pairs_at(np.arange(len(sym)), sym, seq, table)


def _apart(at):
    """Of places that touch (a run of one symbol), every second from the left."""
    start = np.r_[True, np.diff(at) > 1]
    run_first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - run_first) % 2 == 0]


def _sequential(at, sym, seq, pair, slot, low, table):
    """Keep the places up to the first after which a new pair would come before the next place."""
    if len(at) == len(low):
        return at  # one place in each sequence
    last = len(table.key) - 1
    made = table.merged[pair[at]]
    size = len(sym)
    prev, nxt = np.maximum(at - 1, 0), np.minimum(at + 2, size - 1)
    joined = np.r_[False, at[1:] - at[:-1] == 2]
    left = np.where(joined, np.r_[0, made[:-1]], sym[prev])
    l_ok = (at > 0) & (seq[prev] == seq[at])
    r_ok = (at + 2 < size) & (seq[nxt] == seq[at])
    l_rank = table.rank[np.where(l_ok, table.find(left, made), last)]
    r_rank = table.rank[np.where(r_ok, table.find(made, sym[nxt]), last)]
    mine = slot[at]
    stops = np.minimum(l_rank, r_rank) <= low[mine]
    if not stops.any():
        return at
    place = np.arange(len(at))
    limit = np.full(len(low), len(at))
    np.minimum.at(limit, mine[stops], place[stops])
    return at[place <= limit[mine]]
