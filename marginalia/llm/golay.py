"""The binary Golay code (23, 12): every 23-bit word is within 3 bits of exactly one codeword.

Two words at most 2 bits apart have a third one within 1 bit of both. So if each word is given the indices of the
codewords that it and its 23 neighbours decode to (1 or 6 different ones), the two share an index.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed value: the code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
WIDTH, DATA = 23, 12


def _remainder(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(WIDTH - 1, WIDTH - DATA - 1, -1):
        x ^= np.where((x >> bit) & 1, GENERATOR << (bit - (WIDTH - DATA)), 0)
    return x


@lru_cache(maxsize=1)
def indices() -> np.ndarray:
    """For each 23-bit word the index of its codeword (the codeword's upper 12 bits): 8,388,608 entries of 16 bits."""
    errors = [0]
    for a in range(WIDTH):
        errors.append(1 << a)
        for b in range(a):
            errors.append(1 << a | 1 << b)
            errors += [1 << a | 1 << b | 1 << c for c in range(b)]
    errors = np.array(errors, np.int64)
    fix = np.zeros(1 << (WIDTH - DATA), np.int64)
    fix[_remainder(errors)] = errors
    out = np.empty(1 << WIDTH, np.uint16)
    step = 1 << 20
    for at in range(0, 1 << WIDTH, step):
        x = np.arange(at, at + step, dtype=np.int64)
        out[at : at + step] = (x ^ fix[_remainder(x)]) >> (WIDTH - DATA)
    return out


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of each word, ascending; where there is but one, it is repeated."""
    table, words = indices(), words.astype(np.int64)
    near = np.stack([table[words], *(table[words ^ (1 << b)] for b in range(WIDTH))], axis=1)
    near.sort(axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    rank = np.cumsum(new, axis=1) - 1
    out = np.repeat(near[:, :1], 6, axis=1)
    row, col = np.nonzero(new)
    out[row, rank[row, col]] = near[row, col]
    return out
