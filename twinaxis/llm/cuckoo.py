"""A cuckoo filter over arrays of 64-bit hashes: insert, look up and delete in bulk."""

from __future__ import annotations

import numpy as np

SLOTS = 4
U = np.uint64


class CuckooFilter:
    """Generations of bucket tables; a full one is followed by another of its own size.

    A key's fingerprint of 16 bits lies in one of two buckets of four slots.
    Every inserted key is found (no false negatives) until it is deleted as often
    as it was inserted; another key is found by chance about once in 8,000.
    """

    def __init__(self, capacity: int = 1024):
        self.tables = [self._table(capacity)]

    @staticmethod
    def _table(capacity: int) -> np.ndarray:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.8)))))
        return np.zeros((buckets, SLOTS), np.uint16)

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        f = (keys >> U(48)).astype(np.uint16)
        return np.where(f == 0, np.uint16(1), f)

    @staticmethod
    def _other(bucket: np.ndarray, f: np.ndarray, mask: int) -> np.ndarray:
        return (bucket ^ (f.astype(np.int64) * 0x5BD1E995 >> 3)) & mask

    def _places(self, keys: np.ndarray, table: np.ndarray):
        mask, f = len(table) - 1, self._print(keys)
        one = (keys & U(0x7FFFFFFF)).astype(np.int64) & mask
        return f, one, self._other(one, f, mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for t in self.tables:
            f, one, two = self._places(keys, t)
            found |= (t[one] == f[:, None]).any(1) | (t[two] == f[:, None]).any(1)
        return found

    def _insert(self, t: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Indexes of the keys for which there was no room; those have left no trace."""
        before = t.copy()
        f, at, other = self._places(keys, t)
        for bucket in (at, other):
            for s in range(SLOTS):
                rest = np.flatnonzero(f)
                free = rest[t[bucket[rest], s] == 0]
                _, first = np.unique(bucket[free], return_index=True)
                put = free[first]
                t[bucket[put], s] = f[put]
                f[put] = 0
        live = np.flatnonzero(f)
        f, b = f[live], other[live]
        rng = np.random.default_rng(len(keys))
        for _ in range(500):
            if not len(f):
                return np.zeros(0, np.int64)
            # One of the prints that want a bucket enters it; the print it turns out moves on.
            _, first = np.unique(b, return_index=True)
            slot = rng.integers(0, SLOTS, len(first))
            row = t[b[first]]
            empty = row == 0
            slot = np.where(empty.any(1), empty.argmax(1), slot)
            out = t[b[first], slot].copy()
            t[b[first], slot] = f[first]
            f[first] = out
            b[first] = self._other(b[first], out, len(t) - 1)
            stay = f != 0
            f, b = f[stay], b[stay]
        t[:] = before
        return np.arange(len(keys))

    def insert(self, keys: np.ndarray) -> None:
        while len(keys):
            t = self.tables[-1]
            room = int(t.size * 0.85) - int(np.count_nonzero(t))
            now, later = keys[: max(0, room)], keys[max(0, room) :]
            keys = np.concatenate([now[self._insert(t, now)], later]) if len(now) else later
            if len(keys):
                self.tables.append(self._table(max(len(keys), t.size)))

    def delete(self, keys: np.ndarray) -> None:
        """Removes one print of each key; all keys must have been inserted."""
        left = keys
        for t in self.tables:
            f, one, two = self._places(left, t)
            gone = np.zeros(len(left), bool)
            for bucket in (one, two):
                for s in range(SLOTS):
                    hit = np.flatnonzero(~gone & (t[bucket, s] == f))
                    _, first = np.unique(bucket[hit], return_index=True)
                    hit = hit[first]
                    t[bucket[hit], s] = 0
                    gone[hit] = True
            left = left[~gone]
        if len(left):
            self._delete_again(left)

    def _delete_again(self, keys: np.ndarray) -> None:
        # Keys of one bucket and slot compete above; the rest go one by one.
        for k in keys:
            k = np.array([k])
            for t in self.tables:
                f, one, two = self._places(k, t)
                for b in (int(one[0]), int(two[0])):
                    s = np.flatnonzero(t[b] == f[0])
                    if len(s):
                        t[b, s[0]] = 0
                        break
                else:
                    continue
                break

    def to_bytes(self) -> bytes:
        head = np.array([len(self.tables), *(len(t) for t in self.tables)], "<i8").tobytes()
        return head + b"".join(t.astype("<u2").tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        rows = np.frombuffer(raw, "<i8", n, 8)
        at, out.tables = 8 * (n + 1), []
        for r in rows:
            out.tables.append(np.frombuffer(raw, "<u2", int(r) * SLOTS, at).reshape(-1, SLOTS).astype(np.uint16))
            at += int(r) * SLOTS * 2
        return out
