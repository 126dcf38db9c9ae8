"""Suffix sorting by linear grouping.

Suffixes are grouped by their Lyndon prefixes: first by their first symbol, then the groups are processed from the
greatest down. Every member's previous-smaller pointer leads to the nearest position to its left in a lower group; the
positions pointed at are moved, by how many members point at them, to new groups at the end of their own. When all groups
are done, the suffix array is emitted from left to right: each emitted suffix lets the positions up its chain of pointers
take the next places of their groups. Nothing is renamed and nothing recurs.
"""

from __future__ import annotations


def suffix_array(text: bytes | list[int]) -> list[int]:
    """Positions of the suffixes of the text in their order (a suffix that is another's prefix comes first)."""
    s = [*text, -1]  # an end that is smaller than any symbol
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, group, size, before = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for k, i in enumerate(order):
        if s[i] != s[order[start]]:
            start = k
        place[i], group[i] = k, start
        size[start] += 1

    end = n
    while end > 0:
        start = group[order[end - 1]]
        count: dict[int, int] = {}
        for i in sorted(order[start:end]) if end - start > 1 else order[start:end]:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        end = start
        if not count:
            continue
        if len(count) == 1:
            moves = [[next(iter(count))]]
        else:
            by: dict[tuple[int, int], list[int]] = {}
            for p, c in count.items():
                by.setdefault((group[p], c), []).append(p)
            moves = [by[x] for x in sorted(by, reverse=True)]  # within a group, those pointed at most go last
        for moved in moves:
            old = group[moved[0]]
            last = old + size[old]
            for p in moved:
                last -= 1
                q, a = order[last], place[p]
                order[a], place[q] = q, a
                order[last], place[p] = p, last
            size[old] = last - old
            for p in moved:
                group[p] = last
            size[last] = len(moved)

    out, done = [0] * n, [False] * n
    free = list(range(n))  # the next place of the group that starts here
    out[0], done[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out[1:]
