"""Cuckoo filters over digests: sets with insertion and deletion that are never wrong about an absence."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500
#: Filters are built for at most this share of their slots.
LOAD = 0.85
FIRST_BUCKETS = 16


def keys(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, fingerprint) of each digest, from bytes that choose no shard."""
    data = np.frombuffer(b"".join(d[8:18] for d in digests), np.uint8).reshape(len(digests), 10)
    prints = np.ascontiguousarray(data[:, 8:]).view("<u2").ravel()
    return np.ascontiguousarray(data[:, :8]).view("<u8").ravel(), (prints % np.uint16(65535) + np.uint16(1)).astype(np.uint16)


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a digest is in one of two buckets, each found from the other."""

    def __init__(self, buckets: int = FIRST_BUCKETS, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask = np.uint64(len(self.table) - 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    @classmethod
    def build(cls, hashes: np.ndarray, prints: np.ndarray, least: int = FIRST_BUCKETS) -> CuckooFilter:
        """Of digests, all different; as large as they need and ``least`` buckets at least."""
        buckets = least
        while buckets * SLOTS * LOAD < len(hashes):
            buckets *= 2
        while True:
            made = cls(buckets)
            if made.insert(hashes, prints):
                return made
            buckets *= 2

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4B) >> np.uint64(16))) & self.mask

    def places(self, hashes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = hashes & self.mask
        return one, self._other(one, prints)

    def slot_keys(self, hashes: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Equal for digests that the filter cannot tell apart."""
        return np.minimum(*self.places(hashes, prints)) << np.uint64(16) | prints.astype(np.uint64)

    def contains(self, hashes: np.ndarray, prints: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for bucket in self.places(hashes, prints):
            found |= (self.table[bucket] == prints[:, None]).any(1)
        return found

    def insert(self, hashes: np.ndarray, prints: np.ndarray) -> bool:
        """Adds all digests. False if they do not fit; the filter is then of no more use and must be built anew."""
        left = np.arange(len(hashes))
        for bucket in self.places(hashes, prints):
            waiting, full = left, []
            while len(waiting):
                # One digest per bucket at a time, as each takes the next free slot.
                _, first = np.unique(bucket[waiting], return_index=True)
                turn = waiting[first]
                free = self.table[bucket[turn]] == 0
                fits = free.any(1)
                self.table[bucket[turn[fits]], free[fits].argmax(1)] = prints[turn[fits]]
                full.append(turn[~fits])
                rest = np.ones(len(waiting), bool)
                rest[first] = False
                waiting = waiting[rest]
            left = np.concatenate(full) if full else left[:0]
        return all(self._kick(hashes[k] & self.mask, prints[k]) for k in left)

    def _kick(self, bucket: np.uint64, fingerprint: np.uint16) -> bool:
        """Puts one fingerprint in the place of another, that one in its other bucket, and so on."""
        for turn in range(KICKS):
            bucket = self._other(bucket, fingerprint)
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = fingerprint
                return True
            slot = (turn * 7 + int(fingerprint)) % SLOTS
            fingerprint, row[slot] = row[slot], fingerprint
        return False

    def remove(self, hashes: np.ndarray, prints: np.ndarray) -> None:
        """Takes out digests that were inserted, one copy of the fingerprint each."""
        one, two = self.places(hashes, prints)
        for a, b, fingerprint in zip(one, two, prints):
            for bucket in (a, b):
                held = np.flatnonzero(self.table[bucket] == fingerprint)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    def count(self) -> int:
        return int(np.count_nonzero(self.table))
