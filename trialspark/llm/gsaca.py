"""Suffix sorting by linear grouping (Baier, 2016): Lyndon groups in descending order, then one pass.

The Lyndon prefix of a suffix reaches up to the next smaller suffix. Phase one sorts suffixes by their
Lyndon prefixes, highest group first; each processed group lengthens the prefixes of the suffixes
that its previous-smaller pointers name. Phase two emits every group's own order. Nothing is renamed
and nothing is solved recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: bytes) -> np.ndarray:
    """Positions of the suffixes of ``text`` in lexicographic order (shorter first among prefixes)."""
    n = len(text) + 1  # the empty suffix at the end is the smallest
    symbols = np.concatenate([np.frombuffer(text, np.uint8).astype(np.int64) + 1, [0]])
    first = np.argsort(symbols, kind="stable")
    starts = np.searchsorted(symbols[first], symbols)
    order: list[int] = first.tolist()  # suffixes by slot; a group is a run of slots
    group: list[int] = starts.tolist()  # first slot of each suffix's group
    where = [0] * n
    for slot, i in enumerate(order):
        where[i] = slot
    size = np.bincount(starts, minlength=n).tolist()
    smaller = [-1] * n  # previous suffix of a lower group, known once the own group is processed
    _sort_groups(n, order, where, group, size, smaller)
    return np.array(_emit(n, group, smaller)[1:], np.int64)


def _sort_groups(n: int, order: list[int], where: list[int], group: list[int], size: list[int], smaller: list[int]) -> None:
    high = n
    while high > 0:
        g = group[order[high - 1]]
        if g == high - 1:  # a group of one, the common case
            p = order[g] - 1
            while p >= 0 and group[p] > g:
                p = smaller[p]
            smaller[order[g]] = p
            if p >= 0:
                low = group[p]
                left = size[low] - 1
                if left:
                    top = low + left
                    other, at = order[top], where[p]
                    order[top], order[at] = p, other
                    where[p], where[other] = top, at
                    group[p] = top
                    size[low] = left
                    size[top] = 1
            high = g
            continue
        times: dict[int, int] = {}
        for i in sorted(order[g:high]):
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        _raise_groups(times, order, where, group, size)
        high = g


def _raise_groups(times: dict[int, int], order: list[int], where: list[int], group: list[int], size: list[int]) -> None:
    """Move each suffix to a group of its own kind above its old one; more repeats go higher."""
    by_count: dict[int, list[int]] = {}
    for p, k in times.items():
        by_count.setdefault(k, []).append(p)
    for k in sorted(by_count, reverse=True):
        moved: dict[int, int] = {}
        for p in by_count[k]:
            low = group[p]
            done = moved.get(low, 0) + 1
            moved[low] = done
            top = low + size[low] - done
            other, at = order[top], where[p]
            order[top], order[at] = p, other
            where[p], where[other] = top, at
        for low, done in moved.items():
            rest = size[low] - done
            if rest:
                top = low + rest
                size[low], size[top] = rest, done
                for slot in range(top, top + done):
                    group[order[slot]] = top


def _emit(n: int, group: list[int], smaller: list[int]) -> list[int]:
    """Suffixes in order: each one placed puts its left neighbour, and that one's pointers, in place."""
    sorted_suffixes = [-1] * n
    sorted_suffixes[0] = n - 1
    free = list(range(n))  # next free slot of each group, by its first slot
    group[n - 1] = -1
    for slot in range(n):
        p = sorted_suffixes[slot] - 1
        while p >= 0 and group[p] >= 0:
            g = group[p]
            sorted_suffixes[free[g]] = p
            free[g] += 1
            group[p] = -1
            p = smaller[p]
    return sorted_suffixes
