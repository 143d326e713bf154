"""Byte-level BPE by replaying the merges over all words at once, equal to the tiktoken library's ids.

The distinct words of a slice of texts (some MB) are taken together. Their bytes lie in a row; an inverted
index leads from each mergeable pair (known by the token that it gives) to the places where it stands. Pairs are taken
in the order of rank, each at all its places at once, and only the neighbours of a merged place get new pairs, which go
into the index. So the work follows the number of merges that words need, not the number of ranks times words.

Order within a word. The library merges the pair of least rank, the leftmost of equals. Words don't touch each other, so
taking the least rank of all words keeps each word's order. Places of one rank in one word may be merged together unless
the new token could at once start a pair of lesser rank (`early`, told from the vocabulary); then the leftmost place of
each word is merged and the others wait. Of places that share a token the left one goes first.

Words: matches of the vocabulary's pattern. A slice is cut where a match certainly starts; each distinct chunk is split
into words (by classes of characters where these decide, else by the pattern itself), the distinct words are encoded, and
ids are gathered back. A word that is a token is that token, as in the library. Nothing is shuffled and no dictionary of
the corpus is broadcast, since its size would grow with the texts; words that slices share are encoded once in each.

Nulls: a null text is an empty one (no ids, empty decoded bytes). The strings of special tokens are plain text. Repeated
rows give equal results, a null doc_id stays null, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import wordspans as ws
from marginalia.llm.byte_bpe import ByteBpe
from marginalia.llm.common import column, offsets, ragged, slices, table

#: The rank of two tokens that don't merge.
NONE = np.int64(1) << 40
_LETTER, _DIGIT, _MARK, _HARD = range(4)
#: Classes of bytes; 195 to 201 start the letters U+00C0 to U+027F (two signs among them aside).
_KIND = np.full(256, _HARD, np.int8)
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), *range(195, 202)]] = _LETTER
_KIND[39] = _HARD


class Index:
    """From the rank of a pair to the places where it starts; ranks leave in ascending order."""

    def __init__(self):
        self.places: dict[int, list[np.ndarray]] = {}
        self.ranks: list[int] = []

    def put(self, rank: int, at: np.ndarray) -> None:
        if rank in self.places:
            self.places[rank].append(at)
        else:
            self.places[rank] = [at]
            heappush(self.ranks, rank)

    def put_all(self, rank: np.ndarray, at: np.ndarray) -> None:
        """Places by their pairs' ranks; those of no pair are left out."""
        has = rank < NONE
        rank, at = rank[has], at[has]
        if len(at) < 2:
            if len(at):
                self.put(int(rank[0]), at)
            return
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cut = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1], [True]])).tolist()
        for a, b in zip(cut, cut[1:]):
            self.put(int(rank[a]), at[a:b])

    def take(self) -> tuple[int, np.ndarray]:
        rank = heappop(self.ranks)
        parts = self.places.pop(rank)
        return rank, parts[0] if len(parts) == 1 == len(parts[0]) else np.unique(np.concatenate(parts))


class MergeReplay:
    def __init__(self, rank_path: str, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
        # white space as Unicode has it; Python's own \s takes four control characters more
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.n = max(self.rank.values()) + 1
        self.token: list[bytes] = [b""] * self.n
        for t, r in self.rank.items():
            self.token[r] = t
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.size = np.array([len(t) for t in self.token], np.int64)
        self.at = offsets(self.size)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        found = sorted((a * self.n + b, r) for t, r in self.rank.items() for i in range(1, len(t)) if (a := self.rank.get(t[:i])) is not None and (b := self.rank.get(t[i:])) is not None)
        self.pair, self.gives = (np.array(x, np.int64) for x in zip(*found))
        self.early = np.zeros(self.n, bool)
        for half in (self.pair // self.n, self.pair % self.n):
            self.early[half[self.gives < half]] = True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that two tokens give, NONE where they give none."""
        key = left * self.n + right
        i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[i] == key, self.gives[i], NONE)

    def replay(self, raw: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words in a row, and how many each has; bound: len + 1 offsets of the words in raw."""
        n, words = len(raw), len(bound) - 1
        token, word = self.single[raw], np.repeat(np.arange(words), np.diff(bound))
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        filled = np.diff(bound) > 0
        following[bound[1:][filled] - 1] = before[bound[:-1][filled]] = -1
        pair = np.full(n, NONE)
        inner = np.flatnonzero(following >= 0)
        pair[inner] = self.ranks(token[inner], token[inner + 1])
        index = Index()
        index.put_all(pair, np.arange(n))
        while index.ranks:
            rank, at = index.take()
            at = at[pair[at] == rank]  # a place may have changed since it was put there
            if len(at) > 1:
                if self.early[rank]:
                    first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                    if not first.all():
                        index.put(rank, at[~first])
                        at = at[first]
                else:
                    meets = np.concatenate([[False], following[at[:-1]] == at[1:]])
                    if meets.any():  # every second of places in a row
                        place = np.arange(len(at))
                        at = at[(place - np.maximum.accumulate(np.where(meets, 0, place))) % 2 == 0]
            elif not len(at):
                continue
            right = following[at]
            after = following[right]
            token[at], following[at] = rank, after
            token[right], pair[right] = -1, NONE
            more = after >= 0
            before[after[more]] = at[more]
            left = before[at]
            left = left[left >= 0]
            pair[at] = NONE
            touched = np.concatenate([left, at[more]])
            touched = touched[following[touched] >= 0]
            pair[touched] = self.ranks(token[touched], token[following[touched]])
            index.put_all(pair[touched], touched)
        alive = token >= 0
        return token[alive], np.bincount(word[alive], minlength=words)

    def splits(self, raw: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Where the words of chunks start in raw; bound: len + 1 offsets of the chunks, none of them empty.

        A chunk of a space at most, Latin letters, ASCII digits and marks other than the apostrophe has its words where the
        class changes; any other is split by the pattern."""
        kind = _KIND[raw]
        tail = (raw >= 128) & (raw < 192)
        kind[1:][tail[1:] & (kind[:-1] == _LETTER) & (raw[:-1] >= 195)] = _LETTER
        kind[1:][(raw[:-1] == 195) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))] = _HARD
        start, size = bound[:-1], np.diff(bound)
        led = start[(raw[start] == 32) & (size > 1)]
        kind[led] = kind[led + 1]
        hard = np.flatnonzero(np.maximum.reduceat(kind, start) == _HARD)
        cut = np.concatenate([[True], kind[1:] != kind[:-1]])
        cut[start] = True
        whole = raw.tobytes()
        for a, b in zip(start[hard].tolist(), bound[hard + 1].tolist()):
            sizes = [len(w.encode("utf-8")) for w in self.pattern.findall(whole[a:b].decode("utf-8"))]
            cut[a:b] = False
            cut[a + offsets(np.array(sizes[:-1], np.int64))] = True
        return np.flatnonzero(cut)

    def words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where each word's ids start in it and how many they are."""
        key, size = ws.keys(np.concatenate([raw, np.zeros(ws.KEY_BYTES, np.uint8)]), start, end)
        first, number = ws.distinct(key, size)
        whole = raw.tobytes()
        token = np.array([self.rank.get(whole[a:b], -1) for a, b in zip(start[first].tolist(), end[first].tolist())], np.int64)
        left = np.flatnonzero(token < 0)
        ids, parts = self.replay(ragged(raw, start[first[left]], size[first[left]]), offsets(size[first[left]]))
        at, count = np.arange(len(first)) + len(ids), np.ones(len(first), np.int64)
        at[left], count[left] = offsets(parts)[:-1], parts
        return np.concatenate([ids, token]), at[number], count[number]

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row (uint32), and each text's offsets in them."""
        buf, off = ws.bytes_of(array)
        start = ByteBpe.cuts(buf, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        end = np.append(start[1:], off[-1])
        first, number = ws.distinct(*ws.keys(buf, start, end))
        raw, bound = ragged(buf, start[first], end[first] - start[first]), offsets(end[first] - start[first])
        word = self.splits(raw, bound)
        pool, at, count = self.words(raw, word, np.append(word[1:], len(raw)))
        ids = ragged(pool, at, count).astype(np.uint32)
        place = offsets(count)[np.searchsorted(word, bound)]
        size = np.diff(place)[number]
        doc = np.searchsorted(off, start, side="right") - 1
        return ragged(ids, place[:-1][number], size), offsets(np.bincount(doc, weights=size, minlength=len(off) - 1).astype(np.int64))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id lists in a row, and each list's offsets in them."""
        size = self.size[ids]
        return ragged(self.bytes, self.at[ids], size), offsets(size)[at]


@lru_cache(maxsize=2)
def loaded(rank_path: str, pattern: str) -> MergeReplay:
    return MergeReplay(rank_path, pattern)


def public() -> tuple[str, str]:
    """The parameters of the vocabulary installed beside Python."""
    import public_tokenizers as p

    return p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN


def encoded(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each document; no shuffle."""
    vocabulary = vocabulary or public()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(*vocabulary)
        for batch in slices(batches, most=4 << 20):
            ids, at = bpe.encode(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([ids[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, ids binary")


def decoded(encoded: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id and the decoded bytes of each row of encoded(); null ids are none."""
    vocabulary = vocabulary or public()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(*vocabulary)
        for batch in slices(batches, "ids"):
            raw, off = ws.bytes_of(column(batch, "ids"))
            out, at = bpe.decode(np.frombuffer(raw[: off[-1]].tobytes(), "<u4"), off // 4)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([out[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, bytes binary")


def digested(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, taken where the ids are made."""
    vocabulary = vocabulary or public()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(*vocabulary)
        for batch in slices(batches, most=4 << 20):
            ids, at = bpe.encode(column(batch, "text"))
            out, to = bpe.decode(ids, at)
            digest = lambda x, off: pa.array([hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(off, off[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.diff(at)), digest(ids.astype("<u4"), at), digest(out, to)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))
