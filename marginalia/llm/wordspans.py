"""Words of many texts at once: spans over the Arrow buffer, exact keys, and the distinct ones.

A slice of some MB of texts is taken as one byte array. A word is then a (start, end) pair, and its identity is
its bytes packed into four 64-bit integers (a word over 32 bytes: its 128-bit hash), so words are compared,
hashed and counted by numpy instead of one Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

KEY_BYTES = 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Bytes 32 and 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty), with KEY_BYTES zeros behind, and len + 1 offsets."""
    array = pc.fill_null(array, "").cast(pa.large_binary()) if array.type != pa.large_binary() else pc.fill_null(array, b"")
    _, off, data = array.buffers()
    at = np.frombuffer(off, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(KEY_BYTES, np.uint8)]), at - at[0] if len(array) else np.zeros(1, np.int64)


def spans(buf: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and document number of each word: a run of bytes outside `white` within one document."""
    n = int(off[-1])
    full = ~white[buf[:n]]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = full[:-1], full[1:]
    inner = off[(off > 0) & (off < n)]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def per_document(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each document's words."""
    return np.searchsorted(doc, np.arange(n + 1), side="left")


def keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each word's bytes as four integers, and its length."""
    size = end - start
    wide = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    out = []
    for j in range(KEY_BYTES // 8):
        part = np.zeros(len(start), np.uint64)
        has = np.flatnonzero(size > 8 * j) if j else slice(None)
        if j and not len(has):
            out.append(part)
            continue
        part[has] = wide[start[has] + 8 * j] & _MASK[np.minimum(size[has] - 8 * j, 8)]
        out.append(part)
    for i in np.flatnonzero(size > KEY_BYTES):
        h = xxhash.xxh3_128_intdigest(buf[start[i] : end[i]].tobytes())
        out[0][i], out[1][i], out[2][i], out[3][i] = h & (2**64 - 1), h >> 64, 0, 0
    return out, size


def hashes(key: list[np.ndarray], size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    h = mixed(key[0] ^ (size.astype(np.uint64) * _C[0] + np.uint64(seed)))
    for j in range(1, len(key)):
        has = np.flatnonzero(key[j])
        if len(has):
            h[has] = mixed(h[has] ^ (key[j][has] * _C[j] + _C[4]))
    return h


def distinct(key: list[np.ndarray], size: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct word the place of one occurrence, and for each word the number of its distinct word.

    Words are told apart by hash; equal hashes are then compared byte by byte, so the answer is exact."""
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    extra = size if also is None else size * 2 + also
    _, first, number = np.unique(hashes(key, extra), return_index=True, return_inverse=True)
    same = extra[first][number] == extra
    for k in key:
        same &= k[first][number] == k
    if not same.all():
        rows = np.stack([*key, extra.astype(np.uint64)], axis=1)
        _, first, number = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, number.reshape(-1)
