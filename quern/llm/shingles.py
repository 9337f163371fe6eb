"""Word shingles as 64-bit hashes, in numpy.

Words are runs of anything but ASCII whitespace, A-Z lower-cased.  A text's shingles are its
runs of k words; a text of fewer words has one shingle, all of them; one without words has
none.  Hashes come from prefix sums of a polynomial modulo 2^64, finished by a mixer, so every
shingle costs the same whatever its length.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, b in enumerate((BASE, INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s[j]: the polynomial of data[:j]."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data) + 1)[0][: len(data)], out=s[1:])
    return s


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same for equal bytes anywhere."""
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def normal_words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with one space between words, and where words start and end."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    before = np.empty(len(b), bool)
    if len(b):
        before[0], before[1:] = True, space[:-1]
    data = b[~(space & before)].copy()
    space = (data == 32) | ((data >= 9) & (data <= 13))
    data[space] = 32
    if len(data) and space[-1]:
        data, space = data[:-1], space[:-1]
    at = np.flatnonzero(space)
    if not len(data):
        return data, at, at
    return data, np.concatenate([[0], at + 1]), np.concatenate([at, [len(data)]])


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    data, start, end = normal_words(text)
    if not len(start):
        return np.zeros(0, np.uint64)
    n = max(1, len(start) - k + 1)
    return np.unique(range_hashes(prefix_sums(data), start[:n], end[-n:]))
