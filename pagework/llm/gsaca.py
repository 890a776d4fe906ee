"""Suffix array by grouping: linear, without recursion and without renaming.

Phase 1 keeps the suffixes in groups that end up ordered by Lyndon prefix. Groups are taken from the
highest to the lowest. For each suffix of the group, its previous smaller suffix is the nearest one to
the left that lies in a lower group; suffixes that are pointed to move to new groups just above their
old ones, the more pointers the higher. Phase 2 walks the suffix array from its start: each suffix
that is placed places the one before it and that one's chain of previous smaller suffixes, each at the
first free place of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of non-negative numbers. A smaller end mark is implied."""
    n = len(symbols) + 1
    ranked = np.append(np.asarray(symbols, np.int64) + 1, 0)
    order = np.argsort(ranked, kind="stable")
    heads = np.nonzero(np.append(True, np.diff(ranked[order]) > 0))[0]
    sizes = np.diff(np.append(heads, n))
    begin = np.zeros(n, np.int64)  # the group of a suffix, by the place where the group begins
    begin[order] = np.repeat(heads, sizes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    size = [0] * (n + 1)
    for head, count in zip(heads.tolist(), sizes.tolist()):
        size[head] = count
    row, at, group = order.tolist(), place.tolist(), begin.tolist()
    previous = [-1] * n

    end = n
    while end > 0:
        low = group[row[end - 1]]
        members = row[low:end]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            if len(pointed) == 1:
                levels = [list(pointed)]
            else:
                by_count: dict[int, list[int]] = {}
                for j, count in pointed.items():
                    by_count.setdefault(count, []).append(j)
                levels = [by_count[c] for c in sorted(by_count, reverse=True)]
            for level in levels:
                moved: dict[int, int] = {}
                for j in level:
                    old = group[j]
                    shift = moved.get(old, 0) + 1
                    moved[old] = shift
                    last = old + size[old] - shift
                    here = at[j]
                    if here != last:
                        other = row[last]
                        row[last], row[here] = j, other
                        at[j], at[other] = last, here
                for old, count in moved.items():
                    if count < size[old]:
                        new = old + size[old] - count
                        size[old] -= count
                        size[new] = count
                        for j in row[new : new + count]:
                            group[j] = new
        end = low

    free = list(range(n))  # the first free place of each group
    array, placed = [-1] * n, [False] * n
    array[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = array[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            array[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = previous[j]
    return np.array(array[1:], np.int64)


def common_prefixes(symbols: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, how many symbols its suffix shares with the one before it."""
    n = len(array)
    text, order = np.asarray(symbols).tolist(), array.tolist()
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    shared, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            most = n - (i if i > j else j)
            while h < most and text[i + h] == text[j + h]:
                h += 1
            shared[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return np.array(shared, np.int64)
