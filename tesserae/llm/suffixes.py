"""Blockwise suffix sorting with a difference cover, in numpy.

Every suffix is compared by its first `limit` bytes. Suffixes are bucketed by the
order of their first PERIOD bytes, and a bucket is ordered on its own: two of its
suffixes i, j meet at a shift d below PERIOD for which both i+d and j+d lie in the
cover sample, whose ranks were computed beforehand. So long ties cost two rank
look-ups whatever their length, and memory is bounded by the block.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set: each residue modulo 31 is a difference of two members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def _shifts() -> np.ndarray:
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return out


SHIFT = _shifts()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs, in lexicographic order."""
    key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
    return np.unique(key, return_inverse=True)[1]


def sort_suffixes(text: np.ndarray, start: np.ndarray, limit: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(order, class_of): start[order] is sorted by text[s:s+limit]; class_of numbers equal strings, in that order.

    Every start must leave `limit` bytes of text. limit must be at least 4 * PERIOD.
    """
    if limit < 4 * PERIOD or start.size and int(start.max()) + limit > text.size:
        raise ValueError("suffixes must leave `limit` bytes, and limit at least 4 periods")
    if not start.size:
        return start.copy(), start.copy()
    n = text.size
    wide = np.zeros(n + 2 * limit, np.uint8)
    wide[:n] = text
    # names of the strings of 8, 16 and 31 bytes at every position
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= wide[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    name = np.zeros(n + 2 * limit, np.int64)
    name[:n] = np.unique(words, return_inverse=True)[1]
    name[:n] = _pair(name[:n], name[8 : n + 8])
    name[:n] = _pair(name[:n], name[PERIOD - 16 : n + PERIOD - 16])
    # ranks of the cover sample, by strings of `reach` bytes
    reach = limit - 2 * (PERIOD - 1)
    at = np.arange(n)
    at = at[np.isin(at % PERIOD, COVER)]
    rank = name[at]
    covered = PERIOD
    while covered < reach:
        step = min(covered, reach - PERIOD)
        rank = _pair(rank, name[at + step])
        covered = step + PERIOD
    ranks = np.zeros(n + 2 * limit, np.int64)
    ranks[at] = rank
    # buckets by the first PERIOD bytes; each round splits every open bucket by a pivot
    order = np.argsort(name[start], kind="stable")
    place = np.empty(start.size, np.int64)  # position of the suffix's class in sorted order
    first = np.concatenate([[True], np.diff(name[start[order]]) != 0])
    low = np.maximum.accumulate(np.where(first, np.arange(start.size), 0))
    open_ = order
    residue = start % PERIOD
    later = (residue + PERIOD - 1) % PERIOD
    while open_.size:
        head = np.concatenate([[True], low[1:] != low[:-1]])
        group = np.cumsum(head) - 1
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, open_.size))
        pivot = open_[begin + size // 2][group]
        i, j = start[open_], start[pivot]
        side = np.zeros(open_.size, np.int8)
        d1 = SHIFT[residue[open_], residue[pivot]]
        d2 = SHIFT[later[open_], later[pivot]] + PERIOD - 1
        for x, y in ((ranks[i + d1], ranks[j + d1]), (ranks[i + d2], ranks[j + d2]), (name[i + limit - PERIOD], name[j + limit - PERIOD])):
            side = np.where(side == 0, np.sign(x - y).astype(np.int8), side)
        less = np.bincount(group, side < 0).astype(np.int64)
        same = np.bincount(group, side == 0).astype(np.int64)
        done = side == 0
        place[open_[done]] = (low + less[group])[done]
        low = low + np.where(side > 0, (less + same)[group], 0)
        left = ~done
        open_, low = open_[left], low[left]
        again = np.argsort(low, kind="stable")
        open_, low = open_[again], low[again]
    order = np.argsort(place, kind="stable")
    sorted_place = place[order]
    class_sorted = np.cumsum(np.concatenate([[0], np.diff(sorted_place) != 0]))
    class_of = np.empty(start.size, np.int64)
    class_of[order] = class_sorted
    return order, class_of
