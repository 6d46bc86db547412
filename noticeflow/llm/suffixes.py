"""Suffix sorting by linear grouping: suffixes grouped by Lyndon prefix, then ordered group by group.

Phase 1 takes the groups from the highest down.  Every suffix of a group points
at its previous smaller suffix, the nearest one to the left in a lower group; a
suffix that ``l`` members point at moves out of its group, past those with
fewer pointers, so that groups end up as equal Lyndon prefixes.  Phase 2 walks
the order from the smallest suffix: whoever precedes a placed suffix, and its
chain of previous smaller suffixes, takes the next free place of its group.
Nothing is renamed and no smaller problem is solved recursively.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _groups(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """Group start of every suffix (and -1 for "none", the last), and its previous smaller suffix (-1: none)."""
    n = len(text)
    symbols = np.asarray(text)
    by_symbol = np.argsort(symbols, kind="stable")
    sizes = np.unique(symbols, return_counts=True)[1]
    firsts = np.cumsum(sizes) - sizes
    both = np.empty((2, n), np.int64)
    both[:, by_symbol] = np.arange(n), np.repeat(firsts, sizes)
    order, place, start, size = by_symbol.tolist(), both[0].tolist(), [*both[1].tolist(), -1], [0] * n
    for first, count in zip(firsts.tolist(), sizes.tolist()):
        size[first] = count
    previous = [-1] * n
    end = n - 1
    while end >= 0:
        s = order[end]
        low = start[s]
        if low == end:                                   # a group of one: at most one suffix moves
            p = s - 1
            while start[p] >= low:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                old = start[p]
                left = size[old] - 1
                if left:
                    to = old + left
                    other, here = order[to], place[p]
                    order[here], place[other] = other, here
                    order[to], place[p] = p, to
                    start[p] = to
                    size[old], size[to] = left, 1
            end = low - 1
            continue
        members = sorted(order[low:end + 1])
        pointed: dict[int, int] = {}
        for s in members:
            p = s - 1
            while start[p] >= low:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            by_count: dict[int, dict[int, list[int]]] = {}
            for p, count in pointed.items():
                by_count.setdefault(count, {}).setdefault(start[p], []).append(p)
            for count in sorted(by_count, reverse=True):
                for old, moved in by_count[count].items():
                    left = size[old] - len(moved)
                    if not left:                         # the whole group: it stays one
                        continue
                    to = old + size[old] - 1
                    for p in moved:
                        other, here = order[to], place[p]
                        order[here], place[other] = other, here
                        order[to], place[p] = p, to
                        to -= 1
                        start[p] = old + left
                    size[old] = left
                    size[old + left] = len(moved)
        end = low - 1
    return start, previous


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; its last item must be smaller than all others."""
    n = len(text)
    if n == 0:
        return []
    start, previous = _groups(text)
    free = list(range(n))
    out, placed = [-1] * n, bytearray(n + 1)
    out[0], placed[n - 1], placed[n] = n - 1, 1, 1       # the last stands for "none", which ends a chain
    for i in range(n):
        s = out[i] - 1
        while not placed[s]:
            group = start[s]
            at = free[group]
            free[group] = at + 1
            out[at] = s
            placed[s] = 1
            s = previous[s]
    return out
