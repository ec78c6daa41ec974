"""Suffix array by linear grouping: suffixes grouped by Lyndon prefix, then ordered within groups.

First phase: suffixes start in groups by their first symbol.  Groups are taken
in descending order.  For each suffix of the group at hand the nearest suffix
to its left that is in a smaller group (its previous-smaller pointer) has its
Lyndon prefix prolonged by that of the group, once for each suffix that points
to it; suffixes of one group that were prolonged as often leave it for a new
group just above it.  Second phase: from the smallest suffix on, the suffix
before a placed one and those its pointers lead to take the next free place of
their groups.  No names are given anew and nothing recurses.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of a sequence of integers of 0 or more, in lexicographic order; a proper prefix comes first."""
    text = [*text, -1]  # the end is smaller than anything
    symbols = sorted(set(text))
    number = {s: i for i, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    # groups are numbers, linked in order both ways
    lower, upper = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    pointer = [-1] * len(text)
    nearest = list(range(len(text) + 1))  # at i + 1: where the search for a group still to come goes on from i; 0 is none
    order: list[int] = []
    at = len(symbols) - 1
    while at >= 0:
        now = [i for i in members[at] if group[i] == at]
        for i in now:
            nearest[i + 1] = i
        prolonged: dict[int, int] = {}
        for i in now:
            x = i
            while nearest[x] != x:
                nearest[x] = nearest[nearest[x]]
                x = nearest[x]
            nearest[i + 1] = x
            pointer[i] = x - 1
            if x:
                prolonged[x - 1] = prolonged.get(x - 1, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for p, times in prolonged.items():
            parts.setdefault((times, group[p]), []).append(p)
        for times, old in sorted(parts, reverse=True):  # fewer times prolonged: nearer to the old group, so inserted later
            new, above = len(members), upper[old]
            members.append(parts[times, old])
            lower.append(old), upper.append(above)
            upper[old] = new
            lower[above] = new
            for p in members[new]:
                group[p] = new
        members[at] = now
        order.append(at)
        at = lower[at]

    free, place = [0] * len(members), 0
    for g in reversed(order):
        free[g] = place
        place += len(members[g])
    out, placed = [0] * len(text), [False] * len(text)
    out[0], placed[-1] = len(text) - 1, True
    for i in range(len(text)):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = pointer[s]
    return out[1:]
