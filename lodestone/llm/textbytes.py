"""Vectorised kernels over the UTF-8 bytes of an Arrow column of texts.

Everything works on byte arrays in pieces of about half a megabyte, so that the temporaries stay small however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
U64 = np.uint64
_random = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, and the odd base of the polynomial hashes.
BYTE = _random.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n-1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate(([U64(1)], np.cumprod(np.full(max(n, 4096) - 1, BASE, U64))))
    return _powers[:n]


_inverse = np.ones(1, U64)


def inverse_powers(n: int) -> np.ndarray:
    """The inverses of BASE's powers modulo 2**64: with them a hash from the beginning of the data becomes one of a range alone."""
    global _inverse
    if len(_inverse) < n:
        _inverse = np.concatenate(([U64(1)], np.cumprod(np.full(max(n, 4096) - 1, pow(int(BASE), -1, 2**64), U64))))
    return _inverse[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins in them (one more than rows). Nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def longs(column: pa.Array, null: int = -(2**63)) -> np.ndarray:
    return (pc.fill_null(column, null) if column.null_count else column).to_numpy(zero_copy_only=False).astype(np.int64)


def word_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes in the given ranges, bounds included."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words that any white space ends; of words of digits, lower-case letters and all beyond ASCII.
UNSPACED = ~word_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = word_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: What no kernel below may cut apart.
LINE = ~word_class((0x0A, 0x0A))


def pieces(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end at the end of a text or before a byte that is not inside."""
    low, end = 0, len(data)
    while low < end:
        high = min(low + PIECE, end)
        if high < end:
            text_end = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            if text_end > low + PIECE // 2:
                high = text_end
            else:
                while high < end:
                    stop = min(high + PIECE, int(offsets[np.searchsorted(offsets, high, "right")]))
                    out = np.flatnonzero(~inside[data[high:stop]])
                    if len(out):
                        high += int(out[0])
                        break
                    high = stop
                    if stop in offsets[np.searchsorted(offsets, stop) : np.searchsorted(offsets, stop) + 1]:
                        break
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of inside bytes of each text: row, first byte, end, and a 64-bit hash of the folded bytes."""
    found = []
    starts_of_texts = offsets[:-1]
    for low, high in pieces(data, offsets, inside):
        part = data[low:high]
        is_word = inside[part]
        first = np.zeros(len(part) + 1, bool)
        cut = starts_of_texts[np.searchsorted(starts_of_texts, low) : np.searchsorted(starts_of_texts, high)] - low
        first[cut] = True
        before = np.empty(len(part), bool)
        before[0], before[1:] = False, is_word[:-1]
        start = np.flatnonzero(is_word & (~before | first[:-1]))
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = False, is_word[1:]
        end = np.flatnonzero(is_word & (~after | first[1:])) + 1
        if not len(start):
            continue
        length = end - start
        begins = np.cumsum(length) - length
        within = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(begins, length)
        values = BYTE[fold[part[is_word]]] * powers(int(length.max()))[within]
        found.append((start + low, end + low, mix(np.add.reduceat(values, begins) + length.astype(U64))))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U64)
    start, end, hashed = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.searchsorted(offsets, start, "right") - 1, start, end, hashed


def windows(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of k words within a row, and their hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    total = np.zeros(n, U64)
    for j, p in enumerate(powers(k)):
        total += hashes[j : j + n] * p
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return at, mix(total[at] + U64(k))


def covered(start: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie within [start, start + length) of any range."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, minlength=n).astype(np.int64)
