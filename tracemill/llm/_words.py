"""Words and rolling hashes over the bytes of many texts at once, in numpy.

A polynomial hash modulo 2**64 over random byte values: with prefix sums, the hash of any stretch of bytes costs two
look-ups. The final mix spreads the weak low bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = pow(0x9E3779B97F4A7C15, 3, 1 << 64) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(0x5EED)).integers(1, 1 << 64, 256, dtype=np.uint64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** n, modulo 2**64."""
    if (have := _powers.get(base)) is None or len(have) <= n:
        out = np.full(max(n, CHUNK) + 1, base, U)
        out[0] = 1
        have = np.cumprod(out, dtype=U)
        if n <= CHUNK:
            _powers[base] = have
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for two, in order."""
    return mix(a * U(0x9FB21C651E98DF25) + b + U(0x165667B19E3779F9))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


class Prefix:
    """Hashes of stretches of a chunk of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sum = np.zeros(n + 1, U)
        np.cumsum(byte_values()[data] * powers(_BASE, n)[:-1], out=self.sum[1:], dtype=U)
        self.inverse = powers(_INVERSE, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inverse[start])

    def every(self, k: int) -> np.ndarray:
        """Of all stretches of k bytes."""
        return mix((self.sum[k:] - self.sum[:-k]) * self.inverse[: len(self.sum) - k])


def chunks(at: list[int], most: int = CHUNK):
    """Row ranges (first, end) whose bytes fit a chunk."""
    first, rows = 0, len(at) - 1
    while first < rows:
        end = first + 1
        while end < rows and at[end + 1] - at[first] <= most:
            end += 1
        yield first, end
        first = end


def word_bounds(data: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are not ASCII white space, and how many each row has.

    row_at: where each row begins, and the end. A run never spans two rows.
    """
    inside = np.ones(len(data) + 1, bool)
    inside[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    inside[-1] = False
    edge = np.zeros(len(data) + 1, bool)  # a row's first byte
    edge[row_at] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~inside))
    return start, end, np.diff(np.searchsorted(start, row_at))


def word_hashes(data: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of lower-cased text, and how many words each row has."""
    data = lower_ascii(data)
    start, end, counts = word_bounds(data, row_at)
    return Prefix(data).of(start, end), counts


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row; fewer than n words give one hash of them all, none gives none."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = pair(out, h[k : len(h) - n + 1 + k])
    return out
