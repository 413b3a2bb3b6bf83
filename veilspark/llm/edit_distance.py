"""Banded alignment of two word sequences, bit-parallel: a column of the band is one integer.

Bit r of column j stands for row j - limit + r. With m >= n rows and columns, the cell (m, n) lies on one diagonal of
the band; its cost is the start of that diagonal plus one for each column in which the diagonal does not stay level."""

from __future__ import annotations

import numpy as np


def trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common beginning and end."""
    k = min(len(a), len(b))
    d = np.flatnonzero(a[:k] != b[:k])
    k = int(d[0]) if len(d) else k
    a, b = a[k:], b[k:]
    k = min(len(a), len(b))
    d = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
    k = int(d[0]) if len(d) else k
    return a[: len(a) - k], b[: len(b) - k]


def within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Insertions, deletions and replacements between a and b if they are `limit` at most."""
    a, b = trim(a, b)
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > limit:
        return None
    if not n:
        return m
    if m <= limit and len(np.intersect1d(a, b)) == 0:
        return m
    limit = min(limit, m)
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    width = 2 * limit + 1
    full = (1 << width) - 1
    up = full & ~((1 << limit) - 1)
    down, cost, bit = 0, m - n, m - n + limit
    for j, w in enumerate(b.tolist(), 1):
        same = at.get(w, 0)
        if same:
            shift = j - limit - 1
            same = (same >> shift if shift >= 0 else same << -shift) & full
        level = ((((same & up) + up) ^ up) | same | down) & full
        cost += 1 - (level >> bit & 1)
        if cost > limit:
            return None
        right = down | (full & ~(level | up))
        left = level & up
        below = level >> 1
        up, down = left | (full & ~(below | right)), below & right
    return cost


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """1 - distance / longer length reaches `least`."""
    longer = max(len(a), len(b))
    limit = int(np.floor((1 - least) * longer + 1e-9))
    return within(a, b, limit) is not None
