"""Numpy over the bytes of an Arrow column of texts: words, their hashes, windows of hashes.

Everything works on slices of about a megabyte of whole texts, so memory in a task stays bounded by
the longest single text. Hashes have 64 bits: a polynomial over bytes (so that the hash of any stretch
comes from two prefix sums), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are split at white space alone.
DARK = np.ones(256, bool)
DARK[[32, *range(9, 14)]] = False
#: Bytes of words without punctuation: ASCII letters and digits, and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    power, inverse = np.full(n, _BASE, U), np.full(n, _INVERSE, U)
    power[0] = inverse[0] = 1
    return np.cumprod(power, dtype=U), np.cumprod(inverse, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Slice:
    """Some whole texts: bytes, where each text starts, and the row of the first."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of each word; ``bounds`` turns the last into ranges."""
        if not len(self.data):
            return (np.zeros(0, np.int64),) * 3
        inside = kind[self.data]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        first = self.offsets[:-1]
        before[first[first < len(self.data)]] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        last = self.offsets[1:] - 1
        after[last[last >= 0]] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(self.offsets, start, "right") - 1

    def sums(self, latin: bool = False) -> np.ndarray:
        """Prefix sums of the polynomial over lower-cased bytes (A-Z; with latin, Latin-1 capitals too)."""
        power, _ = _powers(max(20, int(len(self.data)).bit_length()))
        out, low = np.zeros(len(self.data) + 1, U), LOWER[self.data]
        if latin:
            at = np.flatnonzero(low[:-1] == 0xC3) + 1
            at = at[(low[at] >= 0x80) & (low[at] <= 0x9E) & (low[at] != 0x97)]
            low[at] += 0x20
        np.cumsum((low.astype(U) + U(1)) * power[: len(low)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inverse = _powers(max(20, int(len(self.data)).bit_length()))
        return mix((sums[end] - sums[start]) * inverse[start])

    def bounds(self, text: np.ndarray) -> np.ndarray:
        """Where the items of each text start, given the text of each item in order."""
        return np.searchsorted(text, np.arange(len(self) + 1))


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[Slice]:
    """Whole texts of an Arrow column, ``most`` bytes at a time or one longer text; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def windows(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row within one text, and the index of the first word of each."""
    if len(words) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    n = len(words) - k + 1
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    out = np.zeros(n, U)
    for i in range(k):
        out = out * U(0xC2B2AE3D27D4EB4F) + words[i : i + n]
    return mix(out[at]), at
