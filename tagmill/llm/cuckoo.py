"""Cuckoo filter: approximate membership with deletion, of one shard of keys."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_KICKS = 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four. Keys are 64-bit hashes; a key may sit in either of two buckets.

    No key that was inserted is ever missed. A full table refuses an insertion and stays
    as it was; ``of`` then takes a larger one.
    """

    def __init__(self, capacity: int = 16):
        buckets = 4
        while buckets * SLOTS * 0.9 < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        """Filter of distinct 64-bit hashes, large enough to take them."""
        capacity = max(16, len(hashes))
        while True:
            made = cls(capacity)
            if all(made._place(h) for h in hashes.tolist()):
                return made
            capacity = int(made.table.size)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls()
        made.table = np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy()
        return made

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, h: int) -> tuple[int, int, int]:
        mask = len(self.table) - 1
        mark = (h >> 48) or 1
        one = h & mask
        return mark, one, one ^ (mark * 0x5BD1E995 & mask)

    def _place(self, h: int) -> bool:
        mark, one, two = self._places(h)
        for b in (one, two):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        mask = len(self.table) - 1
        trail, b = [], two
        for kick in range(MAX_KICKS):
            slot = (kick * 7 + mark) % SLOTS
            out = int(self.table[b, slot])
            trail.append((b, slot, out))
            self.table[b, slot] = mark
            mark = out
            b ^= mark * 0x5BD1E995 & mask
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        for b, slot, out in reversed(trail):  # as it was: no other key may be lost
            self.table[b, slot] = out
        return False

    def insert(self, h: int) -> bool:
        """False if the table is full; the caller then builds a larger one from the exact table."""
        return self._place(h)

    def delete(self, h: int) -> bool:
        """Take one copy of a key out that was inserted before."""
        mark, one, two = self._places(h)
        for b in (one, two):
            at = np.flatnonzero(self.table[b] == mark)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash whether it may be in the filter."""
        hashes = hashes.astype(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        mark = np.maximum(hashes >> np.uint64(48), np.uint64(1))
        one = hashes & mask
        two = one ^ (mark * np.uint64(0x5BD1E995) & mask)
        mark = mark.astype(np.uint16)[:, None]
        return (self.table[one.astype(np.int64)] == mark).any(1) | (self.table[two.astype(np.int64)] == mark).any(1)
