"""A cuckoo filter in numpy: fingerprints of two bytes, four to a bucket, each in one of two buckets. Keys are 64-bit hashes."""

from __future__ import annotations

import numpy as np

from lodestone.llm.textbytes import U64, mix

SLOTS = 4
#: Rounds of evictions after which a filter counts as full, the share of slots that is never exceeded, and the least number of buckets.
ROUNDS, FULL, LEAST = 200, 0.95, 64


class Cuckoo:
    def __init__(self, buckets: int = LEAST, table: bytes | None = None):
        self.mask = U64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy()

    @classmethod
    def of(cls, keys: np.ndarray, buckets: int = LEAST) -> Cuckoo:
        """A filter of all the keys, doubled until they fit."""
        while (made := cls(buckets)) and not made.insert(keys):
            buckets *= 2
        return made

    @property
    def buckets(self) -> int:
        return len(self.table)

    def _marks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0, which is an empty slot) and first bucket."""
        mark = (keys >> U64(48)).astype(np.uint16)
        return np.where(mark == 0, np.uint16(1), mark), (keys & self.mask).astype(np.int64)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The other bucket of a fingerprint: the way there is the way back."""
        return at ^ (mix(mark.astype(U64)) & self.mask).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be there; those that are not named surely are not."""
        mark, at = self._marks(keys)
        return (self.table[at] == mark[:, None]).any(1) | (self.table[self._other(mark, at)] == mark[:, None]).any(1)

    def _fill(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which of them found none."""
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], at[order])
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at)) - first
        free = self.table[at] == 0
        fits = place < free.sum(1)
        slot = (np.cumsum(free, 1) == place[:, None] + 1).argmax(1)
        self.table[at[fits], slot[fits]] = mark[fits]
        return ~fits

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys, each once more. False if the filter is full; it must then be made anew from its keys, as some fingerprints are lost."""
        mark, at = self._marks(keys)
        if np.count_nonzero(self.table) + len(mark) > FULL * self.table.size:
            return False
        for turn in range(ROUNDS):
            for _ in range(2):
                left = self._fill(mark, at)
                mark, at = mark[left], at[left]
                if not len(mark):
                    return True
                at = self._other(mark, at)
            # One newcomer for each full bucket takes the place of another, which has to go to its other bucket.
            _, one = np.unique(at, return_index=True)
            slot = (mix(at[one].astype(U64) + U64(turn * 0x9E3779B9)) % U64(SLOTS)).astype(np.int64)
            out = self.table[at[one], slot]
            self.table[at[one], slot] = mark[one]
            mark[one], at[one] = out, self._other(out, at[one])
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are there, once each."""
        mark, at = self._marks(keys)
        while len(mark):
            other = self._other(mark, at)
            both = np.concatenate((self.table[at], self.table[other]), 1) == mark[:, None]
            slot = both.argmax(1)
            cell = np.where(slot < SLOTS, at, other) * SLOTS + slot % SLOTS
            _, one = np.unique(cell, return_index=True)
            self.table.reshape(-1)[cell[one[both[one].any(1)]]] = 0
            rest = np.ones(len(mark), bool)
            rest[one] = False
            mark, at = mark[rest], at[rest]
