"""Suffix arrays by linear grouping over Lyndon prefixes.

Every suffix i has a Lyndon prefix, which ends where the next smaller suffix begins. In the tree of previous-
smaller pointers, that prefix is the suffix's first byte followed by the prefixes of its children in text
order, largest first. So groups of suffixes with equal prefixes come out in one sweep: begin with groups by
first byte, take the groups in descending order, and append the group in hand to the parents of its
members. Of the parents that share a group, those with more children in the group in hand are larger and
move to a new group above those with fewer. A taken group never changes again.

Then the order inside groups is emitted without any renaming: going up the array, the suffix before the one in
hand takes the next free place of its group, and so do its previous-smaller pointers until one has its place.
"""

from __future__ import annotations

#: Order-preserving map of UTF-8 bytes that leaves 0 (end) and 1 (separator) free: UTF-8 has no byte 0xC0 or 0xC1.
SHIFT = bytes([*range(2, 0xC2), 0, 0, *range(0xC2, 0x100)])
END, SEPARATOR = b"\x00", b"\x01"
_STEP = 64


def _less(t: bytes, j: int, i: int) -> bool:
    """Whether suffix j is smaller than suffix i, in steps that double."""
    step = _STEP
    while True:
        x, y = t[j : j + step], t[i : i + step]
        if x != y:
            return x < y
        j, i, step = j + step, i + step, 2 * step


def previous_smaller(t: bytes) -> list[int]:
    """For each suffix the nearest one before it that is smaller, or -1."""
    out = [-1] * len(t)
    for i in range(1, len(t)):
        j, a = i - 1, t[i]
        while j >= 0:
            b = t[j]
            if b < a:
                break
            if b == a:
                x, y = t[j : j + _STEP], t[i : i + _STEP]
                if x < y or (x == y and _less(t, j + _STEP, i + _STEP)):
                    break
            j = out[j]
        out[i] = j
    return out


def lyndon_groups(t: bytes, pss: list[int]) -> tuple[list[list[int]], list[int]]:
    """(groups in ascending order, group number of each suffix)."""
    members: list[list[int]] = []
    first: dict[int, int] = {}
    for byte in sorted(set(t)):
        first[byte] = len(members)
        members.append([])
    group = [0] * len(t)
    for i, byte in enumerate(t):
        g = first[byte]
        group[i] = g
        members[g].append(i)
    size = [len(m) for m in members]
    above = [*range(1, len(members)), -1]
    below = list(range(-1, len(members) - 1))
    done: list[list[int]] = []
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if len(own) != size[g]:
            own = [i for i in own if group[i] == g]
        for i in own:
            group[i] = ~len(done)
        done.append(own)
        if len(own) == 1:
            p = pss[own[0]]
            if p >= 0:
                h = group[p]
                if size[h] > 1:
                    size[h] -= 1
                    new = len(members)
                    members.append([p])
                    size.append(1)
                    group[p] = new
                    up = above[h]
                    above.append(up)
                    below.append(h)
                    below[up] = new
                    above[h] = new
        else:
            counts: dict[int, int] = {}
            for i in own:
                p = pss[i]
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for p, n in counts.items():
                key = (group[p], n)
                if key in moves:
                    moves[key].append(p)
                else:
                    moves[key] = [p]
            # fewer children first: each new group goes right above its old one, under what was moved there before
            for key in sorted(moves, key=lambda k: -k[1]) if len(moves) > 1 else moves:
                h, moved = key[0], moves[key]
                if len(moved) == size[h]:
                    continue  # all that is left of the group moves: it stays where it is
                size[h] -= len(moved)
                new = len(members)
                members.append(moved)
                size.append(len(moved))
                for p in moved:
                    group[p] = new
                up = above[h]
                above.append(up)
                below.append(h)
                below[up] = new
                above[h] = new
        g = below[g]
    done.reverse()
    last = len(done) - 1
    return done, [last - ~x for x in group]


def suffix_array(t: bytes) -> list[int]:
    """Of a text whose last byte is smaller than all others."""
    pss = previous_smaller(t)
    groups, group = lyndon_groups(t, pss)
    start, at = [], 0
    for members in groups:
        start.append(at)
        at += len(members)
    out = [0] * len(t)
    open_ = [True] * len(t)
    out[0] = len(t) - 1
    open_[-1] = False
    for i in out:
        j = i - 1
        while j >= 0 and open_[j]:
            g = group[j]
            s = start[g]
            out[s] = j
            start[g] = s + 1
            open_[j] = False
            j = pss[j]
    return out
