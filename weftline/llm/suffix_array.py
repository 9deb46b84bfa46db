"""Suffix arrays by linear grouping, for many short strings at once or for one long string.

Phase 1 keeps suffixes in groups, at first by first symbol, and processes the groups from the
highest down. For each suffix of a group it finds the previous smaller suffix, the nearest one to
the left whose group is lower. Suffixes that are someone's previous smaller suffix move up into a
new group just above their own, the higher the more often they were pointed at. In the end a
group holds the suffixes that share their longest Lyndon prefix. Phase 2 walks the suffix array
from the lowest suffix up; the suffix to the left of each one, and the chain of previous smaller
suffixes from there, take the next free place of their groups. Nothing is renamed and nothing
recurses.
"""

from __future__ import annotations

import numpy as np


def sort_many(text: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings laid end to end, one step of all strings at a time.

    text: symbols; string s is text[edges[s]:edges[s + 1]] and ends with a symbol that is lower than
    all others in it. Returns places in text: those of string s in order at edges[s]:edges[s + 1].
    """
    n, n_strings = len(text), len(edges) - 1
    owner = np.repeat(np.arange(n_strings), np.diff(edges))
    # one place more at the front, so that the place before the first string exists
    first = edges[:-1] + 1
    top = edges[1:] + 1
    key = owner * (int(text.max(initial=0)) + 1) + text
    sa = np.concatenate([[0], np.argsort(key, kind="stable") + 1])
    isa = np.empty(n + 1, np.int64)
    isa[sa] = np.arange(n + 1)
    ranked = key[sa[1:] - 1]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) + 1
    sizes = np.diff(np.concatenate([heads, [n + 1]]))
    group = np.empty(n + 1, np.int64)
    group[0] = -1
    group[sa[1:]] = np.repeat(heads, sizes)
    size = np.zeros(n + 2, np.int64)
    size[heads] = sizes
    begin = np.concatenate([[0], first[owner]])  # of the string that a place belongs to
    prev = np.zeros(n + 1, np.int64)
    moved = np.zeros(n + 1, bool)

    live = np.flatnonzero(top - first > 1)
    while len(live):
        end = top[live]
        low = group[sa[end - 1]]
        count = end - low
        shift = np.cumsum(count) - count
        member = sa[np.arange(count.sum()) + np.repeat(low - shift, count)]
        current = np.repeat(low, count)
        p = member - 1
        prev[member] = p
        wait = np.flatnonzero(group[p] >= current)
        while len(wait):
            p[wait] = prev[p[wait]]
            prev[member[wait]] = p[wait]
            wait = wait[group[p[wait]] >= current[wait]]
        inside = p >= begin[member]
        target, times = np.unique(p[inside], return_counts=True)
        if len(target):
            old = group[target]
            order = np.lexsort((times, old))
            target, times, old = target[order], times[order], old[order]
            new_block = np.concatenate([[True], old[1:] != old[:-1]])
            starts = np.flatnonzero(new_block)
            in_block = np.diff(np.concatenate([starts, [len(old)]]))
            tail = np.repeat(old[starts] + size[old[starts]] - in_block, in_block)
            place = tail + np.arange(len(old)) - np.repeat(starts, in_block)
            was = isa[target]
            moved[target] = True
            there = sa[place]
            out = there[~moved[there]]
            gap = was[was < tail]
            sa[gap] = out
            isa[out] = gap
            sa[place] = target
            isa[target] = place
            moved[target] = False
            size[old[starts]] -= in_block
            runs = np.flatnonzero(new_block | np.concatenate([[True], times[1:] != times[:-1]]))
            length = np.diff(np.concatenate([runs, [len(old)]]))
            group[target] = np.repeat(place[runs], length)
            size[place[runs]] = length
        top[live] = low
        live = live[low - first[live] > 1]

    result = np.zeros(n + 1, np.int64)
    result[first] = edges[1:]  # the last symbol's suffix
    placed = np.zeros(n + 1, bool)
    placed[0] = True
    placed[edges[1:]] = True
    slot = np.arange(n + 2)
    by_length = np.argsort(-np.diff(edges), kind="stable")
    lengths = np.diff(edges)[by_length]
    starts = first[by_length]
    alive = len(starts)
    for step in range(int(lengths[0]) if n_strings else 0):
        while alive and lengths[alive - 1] <= step:
            alive -= 1
        j = result[starts[:alive] + step] - 1
        lowest = starts[:alive]
        go = np.flatnonzero((j >= lowest) & ~placed[j])
        j, lowest = j[go], lowest[go]
        while len(j):
            at = slot[group[j]]
            slot[group[j]] = at + 1
            result[at] = j
            placed[j] = True
            j = prev[j]
            go = np.flatnonzero((j >= lowest) & ~placed[j])
            j, lowest = j[go], lowest[go]
    return result[1:] - 1


def sort_one(text: list[int]) -> list[int]:
    """The suffix array of one string that ends with a symbol lower than all others in it."""
    n = len(text)
    sa = sorted(range(n), key=text.__getitem__)
    isa = [0] * n
    group = [0] * n
    size = [0] * (n + 1)
    head = 0
    for at, i in enumerate(sa):
        if text[i] != text[sa[head]]:
            head = at
        isa[i] = at
        group[i] = head
        size[head] += 1
    prev = [-1] * n
    end = n
    while end > 1:
        low = group[sa[end - 1]]
        times: dict[int, int] = {}
        for i in sorted(sa[low:end]):
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, k in times.items():
            by_times.setdefault(k, []).append(p)
        for k in sorted(by_times, reverse=True):
            # to the top of their groups; groups that were split off there before are higher
            by_group: dict[int, list[int]] = {}
            for p in by_times[k]:
                by_group.setdefault(group[p], []).append(p)
            for old, own in by_group.items():
                new = old + size[old] - len(own)
                for at, p in enumerate(own, new):
                    other, was = sa[at], isa[p]
                    sa[was], isa[other] = other, was
                    sa[at], isa[p] = p, at
                size[old] -= len(own)
                size[new] = len(own)
                for p in own:
                    group[p] = new
        end = low
    result = [-1] * n
    placed = [False] * n
    slot = list(range(n + 1))
    result[0] = n - 1
    placed[n - 1] = True
    for at in range(n):
        j = result[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            result[slot[g]] = j
            slot[g] += 1
            placed[j] = True
            j = prev[j]
    return result
