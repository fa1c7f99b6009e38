"""Suffix arrays by linear grouping.

First phase: suffixes are grouped by their Lyndon prefixes. Starting with groups
of equal first symbols, groups are processed in descending order. For every
suffix of the current group, the previous smaller pointer leads to the nearest
suffix to its left that stands in a smaller group; that suffix is followed by
the group's Lyndon word, so it moves up into a new group right above the rest of
its own. Suffixes followed by more copies of the word go higher than those
followed by fewer.

Second phase: with groups in their final places, the array is filled from the
least suffix on. Behind each emitted suffix, the chain of previous smaller
pointers lists the suffixes whose Lyndon word ends there; each goes to the next
free place of its group. Nothing is renamed and nothing is sorted recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The start positions of all suffixes of ``text`` (non-negative integers) in
    lexicographic order; a proper prefix comes first."""
    n = len(text) + 1
    symbols = np.zeros(n, np.int64)
    symbols[:-1] = np.asarray(text, np.int64) + 1  # 0: the end
    by = np.argsort(symbols, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(symbols[by]) != 0]))
    sizes = np.diff(np.append(head, n))
    first = np.empty(n, np.int64)
    first[by] = np.repeat(head, sizes)
    place = np.empty(n, np.int64)
    place[by] = np.arange(n)
    # order: suffixes by group; place: where a suffix stands in it; group: where
    # its group begins; size: of the group that begins there
    order, place, group, size = by.tolist(), place.tolist(), first.tolist(), [0] * n
    for h, s in zip(head.tolist(), sizes.tolist(), strict=True):
        size[h] = s
    previous = [-1] * n
    end = n
    while end > 0:
        begin = group[order[end - 1]]
        if end - begin == 1:
            s = order[begin]
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                h = group[p]
                k = size[h] - 1
                if k:  # alone in its group, it stays
                    last = h + k
                    q, at = order[last], place[p]
                    order[at], place[q], order[last], place[p] = q, at, p, last
                    size[h], size[last], group[p] = k, 1, last
            end = begin
            continue
        members = sorted(order[begin:end])
        follow: dict[int, int] = {}  # how many copies of the word follow a suffix
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                follow[p] = follow.get(p, 0) + 1
        if follow:
            most = max(follow.values())
            if most == 1:
                levels = [follow]
            else:
                split: list[list[int]] = [[] for _ in range(most)]
                for p, c in follow.items():
                    split[c - 1].append(p)
                levels = reversed(split)
            for level in levels:
                moved: dict[int, list[int]] = {}
                for p in level:
                    h = group[p]
                    k = size[h] - 1
                    last = h + k
                    q, at = order[last], place[p]
                    order[at], place[q], order[last], place[p] = q, at, p, last
                    size[h] = k
                    moved.setdefault(h, []).append(p)
                for h, ps in moved.items():
                    new = h + size[h]
                    size[new] = len(ps)  # new is h if the whole group moved
                    if new != h:
                        for p in ps:
                            group[p] = new
        end = begin
    # second phase
    out = [0] * n
    out[0] = n - 1
    free = list(range(n))  # the next free place of the group that begins here
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return np.array(out[1:], np.int64)
