"""Hashes of words and of word shingles, for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import word_bounds

_rng = np.random.default_rng(20240229)
#: A random number for each byte; A-Z count as a-z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASES = (_BASE, pow(_BASE, -1, 2**64))
_kept: list[np.ndarray] = []


#: Bytes that are hashed at once; a word may lie across the border of two such stretches.
STRETCH = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse; tables of one size, of a stretch and a word that is not long, are kept."""
    if n > STRETCH:
        return tuple(_power(base, n) for base in _BASES)
    if not _kept:
        _kept.extend(_power(base, STRETCH) for base in _BASES)
    return _kept[0][:n], _kept[1][:n]


def _power(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    m = np.uint64(0xD6E8FEB86659FD93)
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(32))) * m
    x = (x ^ (x >> np.uint64(32))) * m
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts in raw, cut at offsets, and where each text's words begin."""
    offsets = offsets - offsets[0]
    start, end = word_bounds(raw, offsets)
    h, first = np.empty(len(start), np.uint64), 0
    while first < len(start):  # words that begin within a stretch; the last may be longer than that
        last = int(np.searchsorted(start, start[first] + STRETCH // 2))
        h[first:last] = _hashed(raw, start[first:last], end[first:last])
        first = last
    return h, np.searchsorted(start, offsets)


def _hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    low = int(start[0])
    part = _BYTE[raw[low : int(end[-1])]]
    power, inverse = _powers(len(part) + 1)
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(part * power[: len(part)], out=total[1:])
    start, end = start - low, end - low
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of k words of one text, in order; of all its words if it has fewer."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h += words[j : n - k + 1 + j] * _PLACE[j % 64] + np.uint64(j // 64)
    return mix(h)
