"""Texts as sequences of lower-case letters with single spaces between runs, and their character n-grams as numbers."""

from __future__ import annotations

import sys

import numpy as np

_tables: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _tables:
        _tables.append(np.frombuffer("".join("1" if chr(c).isalpha() else "0" for c in range(sys.maxunicode + 1)).encode(), np.uint8) == 49)
    return _tables[0]


def sequences(texts: list[str | None], before: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the texts' characters one after the other, text i at starts[i]:starts[i + 1].

    A text begins with `before` spaces; what isn't a letter becomes a space, and a run of those one space.
    Codes are UTF-16's: a letter beyond 16 bits is two of them. A null text is empty; a text without letters is its
    first spaces.
    """
    pad = " " * before
    lower = [pad + t.lower() + " " if t else pad for t in texts]
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)))))
    letter = _is_letter()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    for k in range(before):
        keep[start[:-1] + k] = True
    out = np.where(letter, code, 32).astype(np.uint64)[keep]
    place = np.concatenate(([0], np.cumsum(keep)))[start]
    wide = out > 0xFFFF
    if wide.any():
        size = np.where(wide, 2, 1)
        first = np.cumsum(size) - size
        place = np.append(first, size.sum())[place]
        both, rest = np.repeat(out, size), out[wide] - np.uint64(0x10000)
        both[first[wide]] = np.uint64(0xD800) + (rest >> np.uint64(10))
        both[first[wide] + 1] = np.uint64(0xDC00) + (rest & np.uint64(0x3FF))
        out = both
    return out, place


def grams(codes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, starts of each text's own) for n <= 4: n codes of 16 bits in a number, of windows within one text."""
    size = max(len(codes) - n + 1, 0)
    g = np.zeros(size, np.uint64)
    for k in range(n):
        g = (g << np.uint64(16)) | codes[k : k + size]
    inside = np.ones(size, bool)
    for k in range(1, n):
        at = starts[1:] - k
        inside[at[(at >= 0) & (at < size)]] = False
    short = np.flatnonzero(np.diff(starts) < n)  # a text of fewer than n codes has no window of its own
    for i in short:
        inside[starts[i] : min(starts[i + 1], size)] = False
    count = np.concatenate(([0], np.cumsum(inside)))
    return g[inside], count[np.minimum(starts, size)]


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    return total[starts[1:]] - total[starts[:-1]]


def chunks(texts: list[str | None], most: int = 1 << 19):
    """(first, last) of runs of texts with about `most` characters; a longer text stands alone, whole."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)
