"""Suffix order and longest-previous-factor arrays of a block of bytes, in numpy.

Suffixes are compared on their first ``cap`` bytes. Ranks double from 8 bytes up; the
order of equal prefixes is that of their positions, so that the previous (next) smaller
position in suffix order is the source of the longest earlier match, and the previous
(next) larger one that of the longest later match.
"""

from __future__ import annotations

import numpy as np


def ranks(buf: np.ndarray, cap: int) -> dict[int, np.ndarray]:
    """By length 8, 16, ... below or at cap: the rank of what starts at each byte, zeros beyond the end."""
    n = len(buf)
    word = np.zeros(n + 8, np.uint64)
    word[:n] = buf
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = first << np.uint64(8) | word[k : k + n]
    out, size = {}, 8
    rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
    while True:
        out[size] = rank.astype(np.int32)
        if size * 2 > cap:
            return out
        later = np.zeros(n, np.int64)
        later[: n - size] = rank[size:] + 1
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64)
        size *= 2


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller value, or -1, by pointer jumping."""
    p = np.arange(-1, len(x) - 1)
    todo = np.arange(len(x))
    while len(todo):
        todo = todo[p[todo] >= 0]
        todo = todo[x[p[todo]] >= x[todo]]
        p[todo] = p[p[todo]]
    return p


def common_prefix(buf: np.ndarray, rank: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray, cap: int) -> np.ndarray:
    """The length, up to cap, that the suffixes at i and j share; both have cap bytes."""
    got = np.zeros(len(i), np.int64)
    for size in sorted(rank, reverse=True):
        at = np.flatnonzero(got + size <= cap)
        same = rank[size][i[at] + got[at]] == rank[size][j[at] + got[at]]
        got[at[same]] += size
    open_ = np.flatnonzero(got < cap)
    while len(open_):
        open_ = open_[buf[i[open_] + got[open_]] == buf[j[open_] + got[open_]]]
        got[open_] += 1
        open_ = open_[got[open_] < cap]
    return got


def factors(buf: np.ndarray, starts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending starts, each with cap bytes before its end, the longest previous and next factor up to cap."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = ranks(buf, cap)
    top = max(rank)
    tail = starts + max(0, cap - top)
    key = rank[top][starts].astype(np.int64) * (len(buf) + 2) + rank[top][tail]
    if cap < top or cap > 2 * top:
        raise ValueError("cap must be at least 8")
    order = np.argsort(key, kind="stable")  # suffix order; ties by position
    found = []
    for sign in (1, -1):
        before = previous_smaller(sign * order)
        after = n - 1 - previous_smaller(sign * order[::-1])[::-1]
        best = np.zeros(n, np.int64)
        for source in (before, after):
            ok = np.flatnonzero((source >= 0) & (source < n))
            best[ok] = np.maximum(best[ok], common_prefix(buf, rank, starts[order[ok]], starts[order[source[ok]]], cap))
        out = np.empty(n, np.int64)
        out[order] = best
        found.append(out)
    return found[0], found[1]
