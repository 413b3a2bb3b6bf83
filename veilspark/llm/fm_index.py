"""FM-index over integer texts: suffix array, Burrows-Wheeler transform in a wavelet matrix, sampled positions.

A text is a sequence of runs, each closed by the separator 0; patterns hold no separator, so they never match across
runs. Separators sort below all symbols, each as a symbol of its own (by position), which bounds how far two suffixes
can agree. All searches are vectorised over patterns or rows."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bitmap with constant-time rank: one count for each 64 bits, and a popcount."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones, self.n = int(self.before[-1]), n

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Rank and access of symbols 0 .. 2**depth - 1, highest bit first."""

    def __init__(self, values: np.ndarray, depth: int):
        self.levels, now = [], values
        for d in range(depth - 1, -1, -1):
            bit = (now >> d) & 1 == 1
            b = Bits(bit)
            self.levels.append((d, b, len(now) - b.ones))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at
        for d, b, zeros in self.levels:
            one = (symbols >> d) & 1 == 1
            rl, rh = b.rank(lo), b.rank(hi)
            lo, hi = np.where(one, zeros + rl, lo - rl), np.where(one, zeros + rh, hi - rh)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position, and how often it stands before."""
        symbol, lo = np.zeros_like(at), np.zeros_like(at)
        for d, b, zeros in self.levels:
            one = b[at]
            ra, rl = b.rank(at), b.rank(lo)
            at, lo = np.where(one, zeros + ra, at - ra), np.where(one, zeros + rl, lo - rl)
            symbol |= one.astype(symbol.dtype) << d
        return symbol, at - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; later rounds only touch suffixes that still tie."""
    n = len(text)
    seps = text == 0
    first = text.astype(np.int64) + int(seps.sum())
    first[seps] = np.arange(seps.sum())
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff([*heads, n]))
    sizes = np.repeat(np.diff([*heads, n]), np.diff([*heads, n]))
    open_ = np.flatnonzero(sizes > 1)
    k = 1
    while len(open_):
        at = order[open_]
        group = rank[at]
        after = at + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        perm = np.lexsort((second, group))
        at, group, second = at[perm], group[perm], second[perm]
        order[open_] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        heads = np.flatnonzero(new)
        size = np.diff([*heads, len(at)])
        rank[at] = np.repeat(open_[heads], size)
        open_ = open_[np.repeat(size, size) > 1]
        k *= 2
    return order


class FmIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        """text: runs of symbols 1 .. symbols, each closed by 0."""
        n = len(text)
        sa = suffix_array(text)
        self.n = n
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))]).astype(np.int64)
        self.bwt = Wavelet(text[sa - 1].astype(np.int64), max(1, int(symbols).bit_length()))
        start = np.concatenate([[True], text[:-1] == 0]) if n else np.zeros(0, bool)
        begins = np.flatnonzero(start)
        within = np.arange(n) - np.repeat(begins, np.diff([*begins, n]))
        kept = (within % sample == 0)[sa]  # every run's start is kept, so no walk crosses a separator
        self.marked, self.positions = Bits(kept), sa[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each pattern (patterns of one length, one a line), from its last symbol backwards."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k].astype(np.int64)
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.less[c] + both[: len(c)], self.less[c] + both[len(c) :]
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: back steps until a kept one."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            hit = self.marked[at]
            out[left[hit]] = self.positions[self.marked.rank(at[hit])] + steps
            left, at = left[~hit], at[~hit]
            if len(left):
                symbol, before = self.bwt.access(at)
                at = self.less[symbol] + before
            steps += 1
        return out

    def occurrences(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every occurrence."""
        if not self.n or not len(patterns):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = self.search(patterns)
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(patterns)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return which, self.locate(rows)
