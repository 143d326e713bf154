"""Byte-level BPE ids of many texts at once, equal to those of the tokenizers library.

The vocabulary's pattern starts a new piece before any space or line feed that follows a visible character, and
after a line feed that a visible character follows. A slice of texts is cut there, each distinct piece is
encoded once, and the ids are gathered back in order.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from marginalia.llm import wordspans as ws
from marginalia.llm.common import offsets, ragged

END_OF_TEXT = b"<|endoftext|>"


class ByteBpe:
    def __init__(self, json_path: str, rank_path: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    @staticmethod
    def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Places where a new piece certainly starts, documents' starts included."""
        n = int(off[-1])
        b = buf[:n]
        seen = (b > 32) & (b < 127)
        # a character of two bytes is visible unless its first byte is 0xC2 (which has two kinds of white space)
        two = np.zeros(n, bool)
        two[1:] = (b[1:] >= 128) & (b[1:] < 192) & (b[:-1] >= 195) & (b[:-1] < 224)
        after_seen = np.zeros(n, bool)
        after_seen[1:] = (seen | two)[:-1]
        line = b == 10
        cut = after_seen & ((b == 32) | line)
        cut[1:] |= (line & after_seen)[:-1] & seen[1:]
        cut[off[:-1][off[:-1] < n]] = True
        return np.flatnonzero(cut)

    def pieces(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces in a row, and how many each has.

        A piece is plain if it ends in a visible character and starts with one, or with a space and then one. Plain
        pieces are encoded as one text, since a new piece certainly starts between them; one without a space in
        front gets a line feed there, which is an id of its own and is dropped again."""
        size, fed = end - start, (buf[start] != 32).astype(np.int64)
        head, last, but_last = buf[start + 1 - fed], buf[end - 1], buf[np.maximum(end - 2, 0)]
        tail = ((last > 32) & (last < 127)) | ((size > 1) & (last >= 128) & (but_last >= 195) & (but_last < 224))
        plain = tail & (head > 32) & (head != 127) & (head < 224) & (head != 194) & (size > 1 - fed)
        easy = np.flatnonzero(plain)
        fed, size = fed[easy], size[easy]
        joined = ragged(buf, start[easy] - fed, size + fed)
        joined[(np.cumsum(size + fed) - size - fed)[fed > 0]] = 10
        ids = np.asarray(self.fast.encode_to_numpy(joined.tobytes().decode("utf-8"), allowed_special=set(), disallowed_special=()), np.int64) if len(easy) else np.zeros(0, np.int64)
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(size + fed)) + 1
        count, at, parts = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [ids]
        if len(easy):
            at[easy] = np.concatenate([[0], ends[:-1]]) + fed
            count[easy] = ends - at[easy]
        placed = len(ids)
        for i in np.flatnonzero(~plain).tolist():
            got = self.fast.encode_ordinary(buf[start[i] : end[i]].tobytes().decode("utf-8"))
            at[i], count[i] = placed, len(got)
            placed += len(got)
            parts.append(np.asarray(got, np.int64))
        return ragged(np.concatenate(parts), at, count), count

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row (uint32), and each text's offsets in them."""
        buf, off = ws.bytes_of(array)
        n = len(off) - 1
        start = self.cuts(buf, off)
        if len(start):
            end = np.append(start[1:], off[-1])
            key, size = ws.keys(buf, start, end)
            first, number = ws.distinct(key, size)
            ids, count = self.pieces(buf, start[first], end[first])
            out = ragged(ids.astype(np.uint32), offsets(count)[:-1][number], count[number])
            doc = np.searchsorted(off, start, side="right") - 1
            at = offsets(np.bincount(doc, weights=count[number], minlength=n).astype(np.int64))
            raw = buf[: off[-1]].tobytes()
            special = raw.find(END_OF_TEXT) >= 0
        else:
            out, at, special = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64), False
        if special:  # the library takes this string as one id
            parts = [out[at[i] : at[i + 1]] for i in range(n)]
            for i in range(n):
                text = raw[off[i] : off[i + 1]]
                if END_OF_TEXT in text:
                    parts[i] = np.asarray(self.whole.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.uint32)
            out, at = np.concatenate(parts), offsets(np.array([len(p) for p in parts]))
        return out, at


@lru_cache(maxsize=2)
def loaded(json_path: str, rank_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(json_path, rank_path, pattern)


def public() -> tuple[str, str, str]:
    """The parameters of the vocabulary installed beside Python."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN
