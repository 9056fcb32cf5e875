"""Static 3-wise binary fuse filters (Graf and Lemire, 2022) over 64-bit keys, built with numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: 64-bit finaliser
_S33 = np.uint64(33)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    for m in (_M1, _M2):
        h = (h ^ (h >> _S33)) * m
    return h ^ (h >> _S33)


@dataclass(frozen=True)
class Filter:
    seed: int
    segment: int
    segments: int
    prints: np.ndarray  # uint16, one per slot

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The three slots of each hash, in three consecutive segments."""
        span = np.uint64(self.segment * self.segments)
        first = ((h >> np.uint64(32)) * span) >> np.uint64(32)
        mask = np.uint64(self.segment - 1)
        second = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """False: certainly not a member. True: a member, or one of about 65,536 others."""
        if not len(self.prints):
            return np.zeros(len(keys), bool)
        h = _mix(keys, self.seed)
        a, b, c = self.slots(h)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == _fingerprint(h)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint16)


def build(keys: np.ndarray) -> Filter:
    """A filter of distinct uint64 keys; peeling that fails starts again with the next seed."""
    keys = np.unique(keys)
    n = len(keys)
    if n == 0:
        return Filter(0, 1, 1, np.zeros(0, np.uint16))
    segment = 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)) if n > 1 else 4
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, -(-int(n * factor) // segment) - 2)
    for seed in range(1, 1000):
        done = _peel(keys, Filter(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, segment, segments + seed // 20, np.zeros((segments + seed // 20 + 2) * segment, np.uint16)))
        if done:
            return done
    raise ValueError("no filter found for the keys")


def _peel(keys: np.ndarray, f: Filter) -> Filter | None:
    h = _mix(keys, f.seed)
    at = f.slots(h)
    degree = np.bincount(at.ravel(), minlength=len(f.prints))
    members = np.zeros(len(f.prints), np.int64)  # xor of the remaining keys' numbers at each slot
    for row in at:
        np.bitwise_xor.at(members, row, np.arange(len(keys)))
    order: list[tuple[np.ndarray, np.ndarray]] = []
    single = np.flatnonzero(degree == 1)
    left = len(keys)
    while len(single):
        alone, first = np.unique(members[single], return_index=True)
        order.append((alone, single[first]))
        left -= len(alone)
        touched = at[:, alone]
        np.subtract.at(degree, touched.ravel(), 1)
        np.bitwise_xor.at(members, touched.ravel(), np.tile(alone, 3))
        touched = np.unique(touched)
        single = touched[degree[touched] == 1]
    if left:
        return None
    wanted = _fingerprint(h)
    for alone, slot in reversed(order):
        f.prints[slot] = 0
        a, b, c = at[:, alone]
        f.prints[slot] = f.prints[a] ^ f.prints[b] ^ f.prints[c] ^ wanted[alone]
    return f
