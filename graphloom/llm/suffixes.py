"""Suffix order of a set of short byte strings by grouping on Lyndon prefixes.

Phase 1 starts with groups of equal first bytes and takes groups in descending order.
When a group is taken, its suffixes share their final Lyndon prefix; each points to the
nearest suffix to its left in a lower group (previous-smaller pointers skip what is
done), and suffixes pointed to k times move behind those of their group pointed to less
often. In the end groups are the classes of equal Lyndon prefixes, in order. Phase 2
emits: the end of a string, then every emitted suffix, puts the suffixes whose Lyndon
prefix ends there into the next place of their groups. Each suffix is handled a constant
number of times; nothing is renamed or sorted recursively. A suffix ends with its string;
a proper prefix comes first.

`suffix_orders` does the same for many independent sets of strings at once, a group of each
set in every step.
"""

from __future__ import annotations

import numpy as np


def suffix_order(data: bytes, bounds: list[int]) -> list[int]:
    """All positions of `data` by the suffix that starts there and ends with its string.

    bounds: 0, then the ends of the strings. Equal suffixes come in no set order.
    """
    n = len(data)
    count = [0] * 257
    for c in data:
        count[c + 1] += 1
    for c in range(256):
        count[c + 1] += count[c]
    group_of = [count[c] for c in data]  # a group is named by its first place
    end_of = [0] * (n + 1)
    order, place, at = [0] * n, [0] * n, count[:]
    for i, c in enumerate(data):
        k = at[c]
        order[k], place[i] = i, k
        at[c] = k + 1
    for c in range(256):
        end_of[count[c]] = max(end_of[count[c]], count[c + 1])
    before = list(range(-1, n - 1))
    for b in bounds[:-1]:
        if b < n:
            before[b] = -1
    high = n
    while high:
        low = group_of[order[high - 1]]
        if high - low == 1:  # most groups: one suffix points to one other
            i = order[low]
            p = before[i]
            while p >= 0 and group_of[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                g = group_of[p]
                e = end_of[g]
                if e - g > 1:
                    to = e - 1
                    a, x = place[p], order[to]
                    order[a], place[x] = x, a
                    order[to], place[p] = p, to
                    end_of[g], end_of[to] = to, e
                    group_of[p] = to
            high = low
            continue
        points: dict[int, int] = {}
        for k in range(low, high):
            i = order[k]
            p = before[i]
            while p >= 0 and group_of[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                points[p] = points.get(p, 0) + 1
        targets, k = list(points), 1
        while targets:
            moved: dict[int, list[int]] = {}
            for p in targets:
                g = group_of[p]
                if g in moved:
                    moved[g].append(p)
                else:
                    moved[g] = [p]
            for g, ps in moved.items():
                e = end_of[g]
                if e - g == len(ps):
                    continue  # all of the group: it stays as it is
                to = e
                for p in ps:
                    to -= 1
                    a, x = place[p], order[to]
                    order[a], place[x] = x, a
                    order[to], place[p] = p, to
                end_of[g], end_of[to] = to, e
                for p in ps:
                    group_of[p] = to
            targets = [p for p in targets if points[p] > k]
            k += 1
        high = low
    # phase 2: `free` is the next place of each group
    out, free = [0] * n, list(range(n + 1))
    for b, e in zip(bounds[:-1], bounds[1:], strict=True):
        s = e - 1 if e > b else -1
        while s >= 0:
            g = group_of[s]
            out[free[g]] = s
            free[g] += 1
            s = before[s]
    head = bytearray(n + 1)
    for b in bounds:
        head[b] = 1
    for j in out:  # filled ahead of the reading place
        if head[j]:
            continue  # nothing stands before a string's first byte
        s, stop = j - 1, before[j]
        while s != stop:
            g = group_of[s]
            out[free[g]] = s
            free[g] += 1
            s = before[s]
    return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places of the ranges [low, high), the range of each)."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return low[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of], of


def suffix_orders(data: np.ndarray, begins: np.ndarray, set_begins: np.ndarray) -> np.ndarray:
    """Positions of `data`, set by set, each in the order of `suffix_order`.

    begins: where strings start (none is empty); set_begins: where sets of strings start.
    """
    n = len(data)
    set_ends = np.append(set_begins[1:], n)
    key = np.repeat(np.arange(len(set_begins)), set_ends - set_begins) * 256 + data
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group, end = np.empty(n, np.int64), np.zeros(n, np.int64)
    group[order] = np.repeat(first, np.diff(np.append(first, n)))
    end[first] = np.append(first[1:], n)
    before = np.arange(n) - 1
    before[begins] = -1
    points = np.zeros(n, np.int64)
    live, high = np.arange(len(set_begins)), set_ends.copy()
    while len(live := live[high[live] > set_begins[live]]):
        low = group[order[high[live] - 1]]
        at, of = _ranges(low, high[live])
        i, low_of = order[at], low[of]
        p = before[i]
        on = np.flatnonzero(p >= 0)
        while len(on := on[group[p[on]] >= low_of[on]]):
            p[on] = before[p[on]]
            on = on[p[on] >= 0]
        before[i] = p
        high[live] = low
        target, times = np.unique(p[p >= 0], return_counts=True)
        if not len(target):
            continue
        points[target] = times
        low = np.unique(group[target])
        at, of = _ranges(low, end[low])
        i = order[at]
        times = points[i]
        points[target] = 0
        by = np.lexsort((times, of))
        i, times = i[by], times[by]
        order[at] = i
        head = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (times[1:] != times[:-1])]))
        tail = np.append(head[1:], len(at)) - 1
        group[i] = np.repeat(at[head], tail - head + 1)
        end[at[head]] = at[tail] + 1
    out, free = np.empty(n, np.int64), np.arange(n)
    s = np.append(begins[1:], n) - 1
    while len(s):
        # equal suffixes of a set may come at once
        g = np.sort(group[s])
        rank = np.arange(len(s)) - np.searchsorted(g, g)
        out[free[g] + rank] = s[np.argsort(group[s], kind="stable")]
        np.add.at(free, g, 1)
        s = before[s]
        s = s[s >= 0]
    head = np.zeros(n, bool)
    head[begins] = True
    size = set_ends - set_begins
    live, step = np.flatnonzero(size > 0), 0
    while len(live := live[size[live] > step]):
        j = out[set_begins[live] + step]
        step += 1
        j = j[~head[j]]
        s, stop = j - 1, before[j]
        while len(on := np.flatnonzero(s != stop)):
            s, stop = s[on], stop[on]
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = before[s]
    return out


def brute_order(data: bytes, bounds: list[int]) -> list[int]:
    """The same by sorting, for tests."""
    ends = [e for b, e in zip(bounds[:-1], bounds[1:], strict=True) for _ in range(b, e)]
    return sorted(range(len(data)), key=lambda i: data[i : ends[i]])
