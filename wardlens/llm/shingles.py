"""Words and word shingles of texts as 64-bit hashes, vectorised over Arrow batches.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z.  A word's
hash is a polynomial modulo 2^64, read off prefix sums, and then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import SLICE_BYTES, slices, utf8

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SHIFTS = (30, 27, 31)
MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)    # fixed values of the splitmix64 finaliser

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A"):ord("Z") + 1] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(SHIFTS[0]))
    x = x * np.uint64(MIXERS[0])
    x ^= x >> np.uint64(SHIFTS[1])
    x *= np.uint64(MIXERS[1])
    x ^= x >> np.uint64(SHIFTS[2])
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i < n, modulo 2^64."""
    size = 1 << max(int(n) - 1, 1).bit_length()
    if size not in _POWERS:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(size, BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start places and lengths of the words; none goes over a place in ``breaks``."""
    word = ~_WHITE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    ends = np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends - starts


def words_of(texts: pa.Array):
    """Yields (row, word hashes, word lengths in bytes) of every text."""
    data, offsets = utf8(texts)
    for a, b in slices(np.diff(offsets)):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= 2 * SLICE_BYTES:
            hashes, starts, sizes = _words(data[lo:hi], offsets[a:b + 1] - lo)
            at = np.searchsorted(starts, offsets[a:b + 1] - lo)
            for i in range(b - a):
                yield a + i, hashes[at[i]:at[i + 1]], sizes[at[i]:at[i + 1]]
            continue
        parts = []                              # one very long text, cut at white space
        while lo < hi:
            end = min(lo + SLICE_BYTES, hi)
            while end < hi and not _WHITE[data[end]]:
                end += 1
            hashes, _, sizes = _words(data[lo:end], np.zeros(0, np.int64))
            parts.append((hashes, sizes))
            lo = end
        yield a, *(np.concatenate(x) for x in zip(*parts))


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = (total * np.uint64(BASE)) ^ words[i:len(words) - n + 1 + i]
        total = mix(total)
    return total


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; of fewer words the whole sequence; of none nothing."""
    return np.unique(_shingles(words, min(size, len(words)))) if len(words) else words


def sized_shingles(words: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with each shingle's length, the sum of its words'."""
    if not len(words):
        return words, lengths
    n = min(size, len(words))
    shingles, first = np.unique(_shingles(words, n), return_index=True)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return shingles, (ends[n:] - ends[:-n])[first]
