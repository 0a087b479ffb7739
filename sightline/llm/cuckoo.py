"""A cuckoo filter over 128-bit keys: membership with deletion, no false negatives.

Buckets of four 16-bit fingerprints; a key's second bucket follows from its first and its
fingerprint alone, so entries can be moved and deleted without the key. Entries for which no
place is found go to a stash, which is searched as well: a filter never refuses a key. Its user should
build a larger one before MAX_LOAD of the slots are taken, as only the keys themselves can tell more
bits of their buckets.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 200
MAX_LOAD = 0.85


class CuckooFilter:
    def __init__(self, capacity: int):
        self.bits = max(2, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.75 + 1))))
        self.table = np.zeros((1 << self.bits, SLOTS), np.uint16)
        self.stash: list[tuple[int, int]] = []

    # --- places of keys

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        mark = (k2.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = k1.astype(np.uint64) & mask
        return first.astype(np.int64), self._other(first.astype(np.int64), mark), mark

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        spread = (np.asarray(mark).astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(3)
        return np.asarray(bucket) ^ (spread & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    # --- operations on arrays of keys

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        a, b, mark = self._places(k1, k2)
        found = (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)
        for bucket, m in self.stash:
            found |= ((a == bucket) | (b == bucket)) & (mark == m)
        return found

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Add keys: as arrays while one of their buckets has a free slot, the rest one by one."""
        a, b, mark = self._places(k1, k2)
        todo = np.arange(len(mark))
        for bucket in (a, b):
            while len(todo):
                free = self.table[bucket[todo]] == 0
                first = np.unique(np.where(free.any(1), bucket[todo], -1), return_index=True)
                at = first[1][first[0] >= 0]  # one key of each bucket that has room
                if not len(at):
                    break
                self.table[bucket[todo[at]], free[at].argmax(1)] = mark[todo[at]]
                todo = np.delete(todo, at)
        for i in todo:
            self._insert_one(int(a[i]), int(b[i]), int(mark[i]))

    def _insert_one(self, a: int, b: int, mark: int) -> None:
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return
        bucket = b
        for kick in range(KICKS):
            slot = (mark + kick) % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = int(self._other(np.array([bucket]), np.array([mark], np.uint16))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return
        self.stash.append((bucket, mark))

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Remove keys that were inserted; each removes one entry."""
        for a, b, m in zip(*self._places(k1, k2), strict=True):
            for bucket in (int(a), int(b)):
                hit = np.flatnonzero(self.table[bucket] == m)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break
                if (bucket, int(m)) in self.stash:
                    self.stash.remove((bucket, int(m)))
                    break

    # --- as bytes

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, len(self.stash), *(x for pair in self.stash for x in pair)], "<u8")
        return head.tobytes() + self.table.astype("<u2").tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> CuckooFilter:
        bits, n = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        out = CuckooFilter.__new__(CuckooFilter)
        out.bits = bits
        pairs = np.frombuffer(raw, "<u8", 2 * n, 16)
        out.stash = [(int(a), int(b)) for a, b in pairs.reshape(-1, 2)]
        out.table = np.frombuffer(raw, "<u2", SLOTS << bits, 16 + 16 * n).reshape(-1, SLOTS).copy()
        return out
