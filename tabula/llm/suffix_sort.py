"""Linear grouping construction of a suffix array (Baier, CPM 2016).

First, suffixes are grouped by their longest Lyndon prefix: groups start out by
first symbol and are taken in descending order; every suffix of a group points
to its previous smaller suffix, and the suffixes pointed to move behind their
own group, the further the more often they are pointed to.  Then the order
inside the groups is emitted: going through the suffixes in ascending order, the
ones that end where the current suffix begins are next in their groups.  No
names are given anew and nothing is sorted recursively.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(order, start, prev): suffixes laid out by group, each suffix's group start, its previous smaller suffix."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, start, end = [0] * n, [0] * n, [0] * n  # end is kept at group starts
    at = 0
    while at < n:
        symbol, first = text[order[at]], at
        while at < n and text[order[at]] == symbol:
            start[order[at]] = first
            place[order[at]] = at
            at += 1
        end[first] = at
    prev = [-1] * n
    high = n
    while high:
        low = start[order[high - 1]]
        members = order[low:high]
        members.sort()
        count: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and start[p] >= low:
                p = prev[p]  # a higher group, or an earlier member: its pointer is known
            prev[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            often: dict[int, list[int]] = {}
            for p, k in count.items():
                often.setdefault(k, []).append(p)
            for k in sorted(often, reverse=True):
                moved: dict[int, int] = {}
                for p in often[k]:  # to the tail of its group
                    first = start[p]
                    last = end[first] - 1
                    other, hole = order[last], place[p]
                    order[hole], place[other] = other, hole
                    order[last], place[p] = p, last
                    end[first] = last
                    moved[first] = moved.get(first, 0) + 1
                for first, size in moved.items():
                    new = end[first]
                    for q in range(new, new + size):
                        start[order[q]] = new
                    end[new] = new + size
        high = low
    return order, start, prev


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order (a suffix precedes what it is a prefix of)."""
    n = len(text)
    _, start, prev = lyndon_groups(text)
    free = list(range(n))  # next free place of the group that starts here
    out = [-1] * n
    done = bytearray(n)
    for t in range(-1, n):
        i = (out[t] if t >= 0 else n) - 1
        while i >= 0 and not done[i]:
            group = start[i]
            out[free[group]] = i
            free[group] += 1
            done[i] = 1
            i = prev[i]
    return out
