"""A suffix array by grouping (Baier, 2016).

First, suffixes are grouped by their Lyndon prefixes. Groups are gone through in descending order; a suffix's previous smaller one is reached over the pointers of
the higher groups between, and those reached are split off their groups by how many suffixes of the group point at them. Second, each group's order comes from
the order of the next smaller suffixes: in the order of the array, whoever ends at a suffix takes the next place of its group. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def grouped(text: np.ndarray) -> tuple[list[int], list[int]]:
    """(start of the group of each suffix, previous smaller suffix of each, -1 for none). text: whole numbers, the last one the smallest and met once."""
    t = np.asarray(text)
    order = np.argsort(t, kind="stable")
    held = t[order]
    starts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    n = len(t)
    sizes = np.zeros(n, np.int64)
    sizes[starts] = np.diff(np.append(starts, n))
    link_ = np.zeros(n, np.int64)
    link_[order] = np.repeat(starts, sizes[starts])
    place_ = np.zeros(n, np.int64)
    place_[order] = np.arange(n)
    sa, link, place, size, prev = order.tolist(), link_.tolist(), place_.tolist(), sizes.tolist(), [-1] * n
    end = n - 1
    while end >= 0:
        g = link[sa[end]]
        if g == end:
            s = sa[g]
            p = s - 1
            while p >= 0 and link[p] > g:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                old = link[p]
                m = size[old]
                if m > 1:
                    last, at = old + m - 1, place[p]
                    other = sa[last]
                    sa[at], place[other], sa[last], place[p] = other, at, p, last
                    size[old], size[last], link[p] = m - 1, 1, last
        else:
            # Previous smaller suffixes of the whole group. One that lies in the group itself is a repeat of the same prefix: all of such a run follow what comes before its first.
            members = sa[g : end + 1]
            for s in members:
                p = s - 1
                while p >= 0 and link[p] > g:
                    p = prev[p]
                prev[s] = p
            count: dict[int, int] = {}
            for s in members:
                run = []
                while prev[s] >= 0 and link[prev[s]] == g:
                    run.append(s)
                    s = prev[s]
                p = prev[s]
                for r in run:
                    prev[r] = p  # later members of the run stop here at once
            for s in members:
                p = prev[s]
                if p >= 0:
                    count[p] = count.get(p, 0) + 1
            # Those reached more often come first; dealt by their number, so that all of it takes time by the size of the group.
            by_count: list[list[int]] = []
            for p, c in count.items():
                while len(by_count) < c:
                    by_count.append([])
                by_count[c - 1].append(p)
            for those in reversed(by_count):
                moved: dict[int, int] = {}
                for p in those:
                    old = link[p]
                    m = moved.get(old, 0) + 1
                    moved[old] = m
                    last, at = old + size[old] - m, place[p]
                    other = sa[last]
                    sa[at], place[other], sa[last], place[p] = other, at, p, last
                for old, m in moved.items():
                    if m < size[old]:
                        size[old] -= m
                        size[old + size[old]] = m
                for p in those:
                    old = link[p]
                    if place[p] >= old + size[old]:
                        link[p] = old + size[old]
        end = g - 1
    return link, prev


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in ascending order."""
    link, prev = grouped(text)
    n = len(link)
    sa, nxt, placed = [0] * n, list(range(n)), [False] * n
    sa[0], placed[n - 1], nxt[0] = n - 1, True, 1
    for i in range(n):
        s = sa[i] - 1
        while s >= 0 and not placed[s]:
            g = link[s]
            sa[nxt[g]] = s
            nxt[g] += 1
            placed[s] = True
            s = prev[s]
    return np.array(sa, np.int64)
