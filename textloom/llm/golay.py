"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash of 23-bit fingerprint segments.

A segment is decoded from all 24 points within one bit of it; the indices of the
codewords met (one, or six when the segment is three bits from its codeword) are
its keys.  Two segments at most two bits apart have a point within one bit of
both, so they always share a key; at three or four bits they still often do.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_FLIPS = np.array([0] + [1 << j for j in range(BITS)], np.int32)


def _remainder(v: int) -> int:
    for j in range(BITS - 1, 10, -1):
        if v >> j & 1:
            v ^= _GENERATOR << (j - 11)
    return v


_HIGH = np.array([_remainder(i << 11) for i in range(1 << 12)], np.int32)
_ERROR = np.zeros(1 << 11, np.int32)
for _weight in (1, 2, 3):
    for _bits in combinations(range(BITS), _weight):
        _pattern = sum(1 << b for b in _bits)
        _ERROR[_remainder(_pattern)] = _pattern


def codeword_index(v: np.ndarray) -> np.ndarray:
    """Index (0..4095) of the one codeword within three bits of each 23-bit vector."""
    return (v ^ _ERROR[_HIGH[v >> 11] ^ (v & 0x7FF)]) >> 11


def fuzzy_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: every distinct codeword index met within one bit of each vector."""
    if not len(v):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    near = np.sort(codeword_index(v.astype(np.int32)[:, None] ^ _FLIPS), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    row, column = np.nonzero(new)
    return row, near[row, column]
