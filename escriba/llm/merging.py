"""Merges of byte-pair encoding for many words at once, in numpy.

In every round each word has its pair of the lowest rank merged, the leftmost of several, until no word has a pair with a rank: what
the merges mean, done for all words of a slice in step. A word's symbols are a row of a table; words are taken in groups of
like length, so that rows are short. The ranks of pairs are looked up in a hash table of fixed size.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
#: Longest words of the groups; longer ones are left to the caller.
WIDTHS = (6, 10, 16, 40)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Ranks:
    """Rank and product of pairs of symbols."""

    def __init__(self, left: np.ndarray, right: np.ndarray, product: np.ndarray):
        """Pairs in the order of their ranks."""
        self.product = np.append(product, -1).astype(np.int32)
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(self.slots, -1, dtype=np.int64)
        self.ranks = np.full(self.slots, NONE, dtype=np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        _, first = np.unique(key, return_index=True)
        open_, at = np.sort(first), None
        at = self._slot(key[open_])
        self.probes = 1
        while len(open_):
            free = self.keys[at] == -1
            place, which = np.unique(np.where(free, at, -1), return_index=True)
            taken = which[place >= 0]
            self.keys[at[taken]] = key[open_[taken]]
            self.ranks[at[taken]] = open_[taken]
            rest = np.ones(len(open_), dtype=bool)
            rest[taken] = False
            open_, at = open_[rest], (at[rest] + 1) & (self.slots - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE where there is none (symbols below 0 are no symbols)."""
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NONE)
        out[(left < 0) | (right < 0)] = NONE
        live = np.flatnonzero((found != key) & (found != -1))
        while len(live):
            at[live] = (at[live] + 1) & (self.slots - 1)
            own = self.keys[at[live]]
            hit = own == key[live]
            out[live[hit]] = self.ranks[at[live[hit]]]
            live = live[~hit & (own != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


def merge(symbols: np.ndarray, ranks: Ranks) -> np.ndarray:
    """Rows of symbols (-1 after the last), merged as far as they go."""
    width = symbols.shape[1]
    out = np.full_like(symbols, -1)
    if width < 2:
        return symbols.copy()
    row = np.arange(len(symbols))
    rank = ranks.of(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(symbols), width - 1)
    column = np.arange(width)
    while len(row):
        at = rank.argmin(axis=1)
        every = np.arange(len(row))
        best = rank[every, at]
        done = best == NONE
        if done.any():
            out[row[done], : symbols.shape[1]] = symbols[done]
            keep = ~done
            row, symbols, rank, at, best = row[keep], symbols[keep], rank[keep], at[keep], best[keep]
            if not len(row):
                break
            every = np.arange(len(row))
        symbols[every, at] = ranks.product[best]
        # what stands right of the merged pair moves one place to the left
        take = column[None, : symbols.shape[1] - 1] + (column[None, : symbols.shape[1] - 1] > at[:, None])
        symbols = np.take_along_axis(symbols, take, axis=1)
        if symbols.shape[1] < 2:
            out[row, :1] = symbols
            break
        rank = np.take_along_axis(rank, np.minimum(take[:, : symbols.shape[1] - 1], rank.shape[1] - 1), axis=1)
        before = np.flatnonzero(at > 0)
        rank[before, at[before] - 1] = ranks.of(symbols[before, at[before] - 1], symbols[before, at[before]])
        after = np.flatnonzero(at < symbols.shape[1] - 1)
        rank[after, at[after]] = ranks.of(symbols[after, at[after]], symbols[after, at[after] + 1])
    return out


def merge_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of byte ranges in turn, how many each has, and which were too long to be merged here (they have none). first, last: the symbol of a byte within a range, and of a range's last byte."""
    size = end - start
    count = np.zeros(len(start), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    below = 0
    for width in WIDTHS:
        own = np.flatnonzero((size > below) & (size <= width))
        below = width
        if not len(own):
            continue
        column = np.arange(width)
        n = size[own][:, None]
        at = np.minimum(start[own][:, None] + column, len(raw) - 1)
        got = raw[at]
        symbols = np.where(column < n - 1, first[got], np.where(column == n - 1, last[got], -1)).astype(np.int32)
        done = merge(symbols, ranks)
        full = done >= 0
        count[own] = full.sum(axis=1)
        parts.append((own, done[full]))
    ends = np.cumsum(count)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    for own, values in parts:
        begin, n = ends[own] - count[own], count[own]
        before = np.cumsum(n) - n
        ids[np.arange(len(values)) + np.repeat(begin - before, n)] = values
    return ids, count, np.flatnonzero(size > WIDTHS[-1])
