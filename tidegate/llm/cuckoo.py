"""Cuckoo filters over 64-bit key hashes, filled and probed many keys at a time."""

from __future__ import annotations

import numpy as np

#: Fingerprints of a bucket.
SLOTS = 4
#: Keys for each bucket when a filter is laid out; inserts find room up to a higher load.
KEYS_PER_BUCKET = 2
MIX = np.uint64(0xFF51AFD7ED558CCD)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may stand in either of two buckets.

    ``stash`` holds the (bucket, fingerprint) pairs that found no room, so nothing is lost.
    """

    def __init__(self, slots: np.ndarray, stash: np.ndarray):
        self.slots, self.stash = slots, stash

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / KEYS_PER_BUCKET))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16), np.empty((0, 2), dtype=np.int64))

    @classmethod
    def from_bytes(cls, slots: bytes, stash: bytes) -> CuckooFilter:
        return cls(
            np.frombuffer(slots, "<u2").reshape(-1, SLOTS).copy(), np.frombuffer(stash, "<i8").reshape(-1, 2).copy()
        )

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.slots.astype("<u2").tobytes(), self.stash.astype("<i8").tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket and fingerprint (never 0) of each key."""
        h = keys.astype(np.uint64) * MIX
        h ^= h >> np.uint64(33)
        mask = np.uint64(len(self.slots) - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The partner bucket; of the partner it is the bucket again."""
        shift = (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.slots) - 1)
        return bucket ^ shift.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that were not inserted."""
        first, prints = self.places(keys)
        found = np.zeros(len(keys), dtype=bool)
        for bucket in (first, self.other(first, prints)):
            found |= (self.slots[bucket] == prints[:, None]).any(axis=1)
            if len(self.stash):
                found |= np.isin(bucket * 65536 + prints, self.stash[:, 0] * 65536 + self.stash[:, 1])
        return found

    def insert(self, keys: np.ndarray, rounds: int = 200) -> None:
        """Add keys, each once. A round places what finds room and moves a fingerprint for each of the rest."""
        bucket, prints = self.places(keys)
        draw = np.random.default_rng(len(keys))
        for step in range(rounds):
            if not len(bucket):
                return
            bucket, prints = self._settle(bucket, prints)
            if len(bucket) and step:
                # one newcomer a bucket takes the slot of a resident, which tries its partner bucket
                bucket, prints = self._displace(bucket, prints, draw)
            bucket = self.other(bucket, prints)
        bucket, prints = self._settle(bucket, prints)
        self.stash = np.concatenate([self.stash, np.stack([bucket, prints.astype(np.int64)], axis=1)])

    def _settle(self, bucket: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(bucket, kind="stable")
        bucket, prints = bucket[order], prints[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, dtype=int)
        rank = np.arange(len(bucket)) - np.repeat(starts, np.diff(np.r_[starts, len(bucket)]))
        free = self.slots[bucket] == 0
        fits = rank < free.sum(axis=1)
        at = np.argmax(np.cumsum(free[fits], axis=1) == (rank[fits] + 1)[:, None], axis=1)
        self.slots[bucket[fits], at] = prints[fits]
        return bucket[~fits], prints[~fits]

    def _displace(self, bucket, prints, draw):
        _, one = np.unique(bucket, return_index=True)
        slot = draw.integers(0, SLOTS, len(one))
        out = prints.copy()
        out[one] = self.slots[bucket[one], slot]
        self.slots[bucket[one], slot] = prints[one]
        return bucket, out

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted, each once."""
        first, prints = self.places(keys)
        second = self.other(first, prints)
        stash = {}
        for a, b in self.stash.tolist():
            stash[(a, b)] = stash.get((a, b), 0) + 1
        for a, b, p in zip(first.tolist(), second.tolist(), prints.tolist()):
            for bucket in (a, b):
                slot = np.flatnonzero(self.slots[bucket] == p)
                if len(slot):
                    self.slots[bucket, slot[0]] = 0
                    break
                if stash.get((bucket, p)):
                    stash[(bucket, p)] -= 1
                    break
        self.stash = np.array([k for k, n in stash.items() for _ in range(n)], dtype=np.int64).reshape(-1, 2)
