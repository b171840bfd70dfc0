"""An FM-index over one shard of word symbols: suffix order, wavelet matrix, backward search and sampled positions, in numpy.

Words are mapped to 8-bit symbols by their hash (0 stands after each document), so the wavelet matrix has eight levels
whatever the vocabulary, and five symbols and a position fit one 64-bit sort key. A match of symbols is only a candidate:
the caller compares the full word hashes at the located position.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0
LEVELS = 8
#: Every so many positions, and every first position of a document, the suffix array is kept.
SAMPLE = 16
#: Positions fit 20 bits, so that a sort key holds two ranks and a position.
MOST = 1 << 20


def symbols(hashes: np.ndarray) -> np.ndarray:
    """1 to 255 for each word hash."""
    return ((hashes >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of text in the order of their suffixes. A suffix ends with its document: separators of earlier documents sort first.

    The first round sorts by five symbols; each next one doubles the depth, for the positions that still share a rank.
    """
    n = len(text)
    if n > MOST:
        raise ValueError(f"a shard has at most {MOST} symbols")
    where = np.arange(n, dtype=np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    alive = np.ones(n, dtype=bool)
    depth = 5
    for j in range(depth):
        symbol = np.zeros(n, dtype=np.uint64)
        symbol[: max(0, n - j)] = text[j:]
        key = (key << np.uint64(8)) | np.where(alive, symbol, 0)
        alive &= symbol != SEPARATOR
    order = np.sort((key << np.uint64(20)) | where)
    sa = (order & np.uint64(MOST - 1)).astype(np.int64)
    head = np.empty(n, dtype=bool)
    head[:1] = True
    prefix = order >> np.uint64(20)
    # equal keys with a separator within reach are ordered by position already
    head[1:] = (prefix[1:] != prefix[:-1]) | ((prefix[1:] & np.uint64(0xFF)) == 0)
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        here = sa[at]
        # a tied suffix has no separator within depth, so here + depth stays in the text
        order = np.sort((rank[here].astype(np.uint64) << np.uint64(40)) | (rank[here + depth].astype(np.uint64) << np.uint64(20)) | here.astype(np.uint64))
        here = (order & np.uint64(MOST - 1)).astype(np.int64)
        sa[at] = here
        pair = order >> np.uint64(20)
        new = np.empty(len(at), dtype=bool)
        new[:1] = True
        new[1:] = pair[1:] != pair[:-1]
        head[at] |= new
        rank[here] = np.maximum.accumulate(np.where(head[at], at, 0))
        depth *= 2


class Bits:
    """A bit vector with constant-time rank: packed words and a count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Over text: uint8 symbols in which every document ends with SEPARATOR."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        sa = suffix_array(text)
        self.counts = np.zeros(257, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=256), out=self.counts[1:])
        level = text[sa - 1]
        first = np.zeros(self.n, dtype=bool)
        first[0:1] = True
        first[1:] = text[:-1] == SEPARATOR
        marked = (sa % SAMPLE == 0) | first[sa]
        self.marked, self.samples = Bits(marked), sa[marked]
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for shift in range(LEVELS - 1, -1, -1):
            ones = (level >> shift) & 1 == 1
            self.bits.append(Bits(ones))
            self.zeros.append(int(self.n - ones.sum()))
            level = np.concatenate([level[~ones], level[ones]])
        every = np.arange(256)
        self.base = self._down(every, np.zeros(256, dtype=np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for depth in range(LEVELS):
            ones = self.bits[depth].rank(i)
            i = np.where((symbol >> (LEVELS - 1 - depth)) & 1 == 1, self.zeros[depth] + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Rows before row i whose preceding symbol is this one, counted from the first row that begins with it."""
        return self.counts[symbol] + self._down(symbol, i) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of suffixes that begin with each row of patterns (all of one length)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j].astype(np.int64)
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of these rows: each walks back, symbol by symbol, to a sampled one."""
        rows = rows.astype(np.int64)
        out = np.zeros(len(rows), dtype=np.int64)
        walked = np.zeros(len(rows), dtype=np.int64)
        live = np.arange(len(rows))
        row = rows.copy()
        while len(live):
            done = self.marked.get(row[live])
            at = live[done]
            out[at] = self.samples[self.marked.rank(row[at])] + walked[at]
            live = live[~done]
            i, symbol = row[live], np.zeros(len(live), dtype=np.int64)
            for depth in range(LEVELS):
                one, ones = self.bits[depth].get(i), self.bits[depth].rank(i)
                symbol = symbol * 2 + one
                i = np.where(one, self.zeros[depth] + ones, i - ones)
            row[live] = self.counts[symbol] + i - self.base[symbol]
            walked[live] += 1
        return out
