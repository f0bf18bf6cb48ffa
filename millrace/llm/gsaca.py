"""Suffix sorting by linear grouping."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of all suffixes of ``text`` (numbers of 1 or more) in order.

    Phase 1 sorts suffixes into groups by their longest Lyndon prefix. Groups are
    taken in descending order; a suffix's prev is the last position before it of a
    smaller group, found over the prevs of the positions between. A position that is
    prev of l members of the group extends its own prefix by the group's l times, so
    it moves to a group just above its own, a larger l further up. Phase 2 walks the
    order as it becomes known: the suffixes whose Lyndon prefix ends where the next
    smallest suffix begins are that suffix's left neighbour and its prevs, and each
    goes to the front of what is left of its group. Nothing is renamed or recursed."""
    s = [*text, 0]
    n = len(s)
    sa = sorted(range(n), key=s.__getitem__)  # first groups: by first symbol
    pos, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for r, i in enumerate(sa):
        if r and s[i] != s[sa[r - 1]]:
            start = r
        pos[i], group[i] = r, start
        size[start] += 1
    prev = [-1] * n
    end = n
    while end:
        gs = group[sa[end - 1]]
        if end - gs == 1:
            i = sa[gs]
            p = i - 1
            while p >= 0 and group[p] >= gs:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                old = group[p]
                if size[old] > 1:
                    size[old] = left = size[old] - 1
                    new = old + left
                    q, at = sa[new], pos[p]
                    sa[at], pos[q] = q, at
                    sa[new], pos[p] = p, new
                    group[p], size[new] = new, 1
            end = gs
            continue
        counts: dict[int, int] = {}
        for i in sorted(sa[gs:end]):
            p = i - 1
            while p >= 0 and group[p] >= gs:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        by: dict[tuple[int, int], list[int]] = {}
        for p, k in counts.items():
            by.setdefault((-k, group[p]), []).append(p)
        for (_, old), members in sorted(by.items()) if len(by) > 1 else by.items():
            left = size[old]
            if left == len(members):
                continue
            for p in members:
                left -= 1
                q, at = sa[left + old], pos[p]
                sa[at], pos[q] = q, at
                sa[left + old], pos[p] = p, left + old
            size[old], new = left, old + left
            size[new] = len(members)
            for p in members:
                group[p] = new
        end = gs
    head = group[:]  # by group's first place: the next free place
    done = [False] * n
    out = [0] * n
    out[0], done[n - 1] = n - 1, True
    free = list(range(n))
    for r in range(n):
        i = out[r] - 1
        while i >= 0 and not done[i]:
            g = head[i]
            out[free[g]] = i
            free[g] += 1
            done[i] = True
            i = prev[i]
    return out[1:]
