"""Sorted runs of suffixes: front coding, and a merge that never compares a known prefix again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7 >> 3)


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Sorted suffixes as the length that each has in common with the one before, the length of its rest, and all rests."""
    shared, rests, last = [], [], b""
    for s in suffixes:
        n = common(last, s, 0)
        shared.append(n)
        rests.append(s[n:])
        last = s
    return np.array(shared, np.uint16), np.array([len(r) for r in rests], np.uint16), b"".join(rests)


def front_decode(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> Iterator[tuple[int, bytes]]:
    last, at = b"", 0
    for n, k in zip(shared.tolist(), lengths.tolist(), strict=True):
        last = last[:n] + rests[at : at + k]
        at += k
        yield n, last


class LoserTree:
    """Merges sorted front-coded runs.

    Each run's head knows how much it has in common with the last winner. Of two heads the one with more in common is the smaller, unseen; only if they have
    equally much are bytes compared, from there on. A game leaves the loser with what it has in common with its winner, which is what the next game on that node needs.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs, self.n = runs, 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list[bytes | None] = [None] * self.n
        self.known = [0] * self.n
        for i in range(len(runs)):
            self.pull(i)
        for i in range(len(runs)):
            self.known[i] = 0
        self.losers = [0] * self.n
        self.winner = self.build(1)

    def pull(self, i: int) -> None:
        found = next(self.runs[i], None) if i < len(self.runs) else None
        self.heads[i], self.known[i] = (None, 0) if found is None else (found[1], found[0])

    def build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        return self.play(node, self.build(2 * node), self.build(2 * node + 1))

    def play(self, node: int, a: int, b: int) -> int:
        """The smaller of two heads (of equals the earlier run); the other stays at the node."""
        x, y = self.heads[a], self.heads[b]
        if y is None or x is None:
            win = a if y is None else b
        elif self.known[a] != self.known[b]:
            win = a if self.known[a] > self.known[b] else b
        else:
            n = common(x, y, self.known[a])
            first = x[n : n + 1] < y[n : n + 1] or (x[n : n + 1] == y[n : n + 1] and a < b)
            win = a if first else b
            self.known[b if first else a] = n
        self.losers[node] = b if win == a else a
        return win

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(common with the one before, run, suffix) in order."""
        while (head := self.heads[self.winner]) is not None:
            i = self.winner
            yield self.known[i], i, head
            self.pull(i)
            node = (i + self.n) // 2
            while node:
                i = self.play(node, i, self.losers[node])
                node //= 2
            self.winner = i
