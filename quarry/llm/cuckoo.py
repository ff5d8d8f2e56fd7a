"""A cuckoo filter over 64-bit hashes: 4 slots a bucket, 16-bit fingerprints, deletions."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class CuckooFilter:
    """Holds a multiset of hashes; contains() may say yes wrongly (about 1 in 8,000), never no wrongly."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        """Room for n hashes at a load of 0.8 at most."""
        need = max(1, -(-n * 5 // (4 * SLOTS)))
        return cls(1 << (need - 1).bit_length())

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints, first and second buckets."""
        h = _mixed(hashes.astype(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1  # 0 is an empty slot
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, first ^ self._hop(mark)

    def _hop(self, mark: np.ndarray) -> np.ndarray:
        return (_mixed(mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(hashes)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """Add all; False if the table is too full (then build a larger one: nothing is half kept)."""
        before = self.table.copy()
        for mark, a, b in zip(*(x.tolist() for x in self.places(hashes)), strict=True):
            if not (self._put(a, mark) or self._put(b, mark) or self._kick(b, mark)):
                self.table = before
                return False
        return True

    def _put(self, bucket: int, mark: int) -> bool:
        row = self.table[bucket]
        for s in range(SLOTS):
            if row[s] == 0:
                row[s] = mark
                return True
        return False

    def _kick(self, bucket: int, mark: int) -> bool:
        for k in range(KICKS):
            s = (mark + k) % SLOTS
            mark, self.table[bucket, s] = int(self.table[bucket, s]), mark
            bucket ^= int(self._hop(np.array([mark]))[0])
            if self._put(bucket, mark):
                return True
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Take out one copy of each; only hashes that were inserted may be given."""
        for mark, a, b in zip(*(x.tolist() for x in self.places(hashes)), strict=True):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == mark)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break
            else:
                raise KeyError("the filter does not hold this hash")


def build(hashes: np.ndarray) -> CuckooFilter:
    """A filter of just the size that holds these hashes."""
    made = CuckooFilter.sized(len(hashes))
    while not made.insert(hashes):
        made = CuckooFilter(2 * made.buckets)
    return made
