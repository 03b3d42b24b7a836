"""Suffix arrays by linear grouping (no recursion, no renaming).

Phase 1 refines groups of suffixes, which begin as equal first symbols and end as equal
Lyndon prefixes. Groups are processed from the highest down. Each suffix of a group gets
a pointer to the nearest suffix before it that lies in a lower group; suffixes pointed to
move into new groups right above their old ones, those with more pointers higher.
Phase 2 walks the finished places from the lowest: the suffix before each, and the chain
of its pointers, take the next free place of their groups.
"""

import gc
from collections import Counter
from contextlib import contextmanager

import numpy as np


@contextmanager
def _no_collector():
    """The many short lists hold no cycles; walking them again and again costs half the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _lyndon_groups(symbols: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Group of each suffix, its previous-smaller pointer (-1: none), and the groups from the lowest up."""
    n = len(symbols)
    values, first = np.unique(symbols, return_inverse=True)
    group = first.tolist()
    by_symbol = np.argsort(first, kind="stable")
    ends = np.cumsum(np.bincount(first, minlength=len(values)))
    members = [part.tolist() for part in np.split(by_symbol, ends[:-1])]
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    # The entry behind the last stands for "none" (index -1) and is never done.
    done, prev = bytearray(n + 1), [-1] * n

    def split(moved: list[int]):
        """Moves suffixes into new groups right above their old ones, which lie below the current group."""
        old = group[moved[0]]
        if any(group[j] != old for j in moved):
            together: dict[int, list[int]] = {}
            for j in moved:
                together.setdefault(group[j], []).append(j)
            for part in together.values():
                split(part)
        elif len(moved) < size[old]:
            new, over = len(members), above[old]
            members.append(moved)
            size.append(len(moved))
            size[old] -= len(moved)
            below.append(old)
            above.append(over)
            above[old] = below[over] = new
            for j in moved:
                group[j] = new

    current = len(members) - 1
    while current >= 0:
        own = members[current]
        if size[current] < len(own):  # some have moved on
            own = [i for i in own if group[i] == current]
        if len(own) == 1:  # most groups, so without the detours below
            i = own[0]
            j = i - 1
            while done[j]:
                j = prev[j]
            prev[i] = j
            done[i] = 1
            if j >= 0:
                old = group[j]
                if size[old] > 1:
                    size[old] -= 1
                    over = above[old]
                    above[old] = below[over] = group[j] = len(members)
                    members.append([j])
                    size.append(1)
                    below.append(old)
                    above.append(over)
            current = below[current]
            continue
        own.sort()
        targets = []
        for i in own:
            j = i - 1
            while done[j]:
                j = prev[j]
            prev[i] = j
            done[i] = 1
            targets.append(j)
        if len(set(targets)) == len(targets) and -1 not in targets:  # each is pointed to once
            split(targets)
        else:
            by_pointers: dict[int, list[int]] = {}
            for j, times in Counter(targets).items():
                if j >= 0:
                    by_pointers.setdefault(times, []).append(j)
            for times in sorted(by_pointers, reverse=True):
                split(by_pointers[times])
        current = below[current]
    order = []
    current = 0
    while below[current] >= 0:
        current = below[current]
    while current >= 0:
        order.append(current)
        current = above[current]
    return group, prev, order


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start of every suffix in sorted order; the last symbol must be the only smallest one."""
    with _no_collector():
        return np.asarray(_sorted(symbols))


def _sorted(symbols: np.ndarray) -> list[int]:
    n = len(symbols)
    group, prev, order = _lyndon_groups(symbols)
    size = np.bincount(np.asarray(group), minlength=max(order) + 1)
    free = np.zeros(len(size), np.int64)
    free[order] = np.concatenate([[0], np.cumsum(size[order])[:-1]])
    place = free.tolist()
    # The entry behind the last stands for "none" (index -1).
    out, placed = [0] * n, bytearray(n + 1)
    out[0], placed[n - 1], placed[n] = n - 1, 1, 1
    for i in range(n):
        j = out[i] - 1
        while not placed[j]:
            own = group[j]
            out[place[own]] = j
            place[own] += 1
            placed[j] = 1
            j = prev[j]
    return out
