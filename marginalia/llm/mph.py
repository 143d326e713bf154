"""A minimal perfect hash of 64-bit keys with stored fingerprints, in numpy.

Level by level, the keys left are hashed to a bit array of twice their number; a bit that one key alone hits is
that key's. A key's slot is the number of set bits before its own, over all levels. The file form holds the bit
arrays with a running count for each word, so a lookup reads a few words whatever the number of keys.
"""

from __future__ import annotations

import numpy as np

from marginalia.llm.wordspans import mixed

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys + np.array([level + 1], np.uint64) * _STEP) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class Mph:
    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits = sizes, bits
        counts = [np.bitwise_count(b).astype(np.int64) for b in bits]
        total, self.before = 0, []
        for c in counts:
            self.before.append(total + np.cumsum(c) - c)
            total += int(c.sum())
        self.total = total

    @classmethod
    def build(cls, keys: np.ndarray) -> Mph:
        """keys: distinct uint64 values."""
        sizes, bits, left, level = [], [], keys, 0
        while len(left):
            size = max(64, -(-2 * len(left) // 64) * 64)
            spot = _spot(left, level, size)
            hit = np.bincount(spot, minlength=size)
            words = np.packbits(hit == 1, bitorder="little").view("<u8")
            sizes.append(size)
            bits.append(words)
            left, level = left[hit[spot] > 1], level + 1
        return cls(sizes, bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level has its bit (surely not a key)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, words) in enumerate(zip(self.sizes, self.bits)):
            if not len(left):
                break
            spot = _spot(keys[left], level, size)
            word, bit = spot >> 6, (spot & 63).astype(np.uint64)
            got = words[word]
            has = (got >> bit) & np.uint64(1) == 1
            lower = np.bitwise_count(got & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[has]] = self.before[level][word[has]] + lower[has]
            left = left[~has]
        return out

    def dump(self) -> bytes:
        return b"".join([np.array([len(self.sizes), *self.sizes], "<i8").tobytes(), *(b.tobytes() for b in self.bits)])

    @classmethod
    def load(cls, raw: bytes) -> tuple[Mph, int]:
        """The index, and how many bytes of raw it took."""
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes = np.frombuffer(raw, "<i8", n, 8).tolist()
        at, bits = 8 * (n + 1), []
        for size in sizes:
            bits.append(np.frombuffer(raw, "<u8", size // 64, at))
            at += size // 8
        return cls(sizes, bits), at
