"""Alignment of two tokenizers over a corpus, each distinct text tokenised once.

Texts are shuffled by their full text, so equal ones meet and become one row with its number of copies (copies are summed
before the shuffle too). Each distinct text is encoded by both vocabularies and aligned by byte offsets; corpus-wide counts
of id pairs weigh it by its copies, and its measures are joined to the ids of all its documents by a 256-bit digest.

Alignment. A's and B's token ends cut the bytes of space + text. Each stretch between two neighbouring ends lies in one
token of A and one of B and is their whole overlap, so stretches are the links, one for one. Where both end, a group ends.

Counts. Texts are taken in blocks of some MB. A block numbers its id pairs, the most frequent first, and gives a row for
each pair (with the copies-weighted links) and for each text its pairs as gaps between these numbers. Pair rows are summed
over the corpus, joined back to the blocks that have the pair (at most a row a block and pair, so no key is hot), and
meet the block's texts again by block number. No task gets more than a block; nothing whole is broadcast but a maximum for
each id of B, which is as many rows as B's vocabulary has.

Encoding. A (byte-level) is cut where a new piece certainly starts. B is cut before a space that follows something else:
none of its pieces has a space behind another character, which is checked when it is loaded. Distinct chunks of a
slice are encoded once.

Nulls: null and empty texts, and texts whose joined tokens of A or B aren't space + text, have no tokens: zeros and an empty
digest. A null doc_id stays null; each row gets its measures, repeated rows too. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe
from marginalia.llm import wordspans as ws
from marginalia.llm.common import column, ints, offsets, ragged, slices, table, written
from marginalia.operators.components import join_counted

BLOCK_BYTES = 8 << 20
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_SPACE, _BAR, _SEMICOLON = 32, ord("|"), ord(";")


def _gathered(buf: np.ndarray, off: np.ndarray, start: np.ndarray, encode: Callable) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts in a row and each text's offsets in them; encode takes the distinct chunks that start there."""
    end = np.append(start[1:], off[-1])
    first, number = ws.distinct(*ws.keys(buf, start, end))
    ids, count = encode(buf, start[first], end[first])
    doc = np.searchsorted(off, start, side="right") - 1
    return ragged(ids, offsets(count)[:-1][number], count[number]), offsets(np.bincount(doc, weights=count[number], minlength=len(off) - 1).astype(np.int64))


class Pair:
    """Both vocabularies, and the alignment of texts by them."""

    def __init__(self, json_path: str, rank_path: str, pattern: str, piece_path: str):
        self.a = byte_bpe.ByteBpe(json_path, rank_path, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space behind another character: texts can't be cut at spaces")
        raw = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.b_bytes, self.b_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(rank_path, "rb"))}
        self.a_bytes, self.a_size = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8), self.a.size
        self.n_b, most = n, max(n, len(self.a_size))
        shown = [b"%d," % i for i in range(most)]
        self.digits, self.shown = np.frombuffer(b"".join(shown), np.uint8), np.array([len(s) for s in shown], np.int64)
        self.lead = len(self.b.encode("x"))

    def pieces(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of chunks; a letter in front of each takes the space that the library would put there."""
        raw = buf.tobytes()
        got = self.b.encode(["x" + raw[a:b].decode("utf-8") for a, b in zip(start.tolist(), end.tolist())], num_threads=1)
        count = np.array([len(g) - self.lead for g in got], np.int64)
        return np.array([i for g in got for i in g[self.lead :]], np.int64), count

    @staticmethod
    def _same(pool: np.ndarray, size: np.ndarray, ids: np.ndarray, at: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each text whether its tokens' bytes are the text's."""
        made = offsets(size[ids])[at]
        same = np.diff(made) == np.diff(off)
        if not same.all():  # lengths differ: the others are moved to where they belong
            ids = ragged(ids, at[:-1][same], np.diff(at)[same])
        joined, texts = ragged(pool, offsets(size)[:-1][ids], size[ids]), ragged(buf, off[:-1][same], np.diff(off)[same])
        differ = np.flatnonzero(joined != texts)
        rows = np.flatnonzero(same)
        same[rows[np.searchsorted(offsets(np.diff(off)[same]), differ, side="right") - 1]] = False
        return same

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of A and each text's offsets in them, the same of B, and len + 1 byte offsets. Texts are not null; one that
        has no tokens takes no bytes."""
        large = pa.large_string()
        buf, off = ws.bytes_of(pc.binary_join_element_wise(pa.scalar(" ", large), texts.cast(large), pa.scalar("", large)))
        n = int(off[-1])
        ids_a, at_a = _gathered(buf, off, byte_bpe.ByteBpe.cuts(buf, off), self.a.pieces)
        space = buf[:n] == _SPACE
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[off[:-1]] = True
        ids_b, at_b = _gathered(buf, off, np.flatnonzero(cut), self.pieces)
        same = self._same(self.a_bytes, self.a_size, ids_a, at_a, buf, off) & self._same(self.b_bytes, self.b_size, ids_b, at_b, buf, off) & (np.diff(off) > 1)
        if not same.all():
            ids_a, ids_b = (ragged(i, at[:-1][same], np.diff(at)[same]) for i, at in ((ids_a, at_a), (ids_b, at_b)))
            at_a, at_b, off = (offsets(np.where(same, np.diff(x), 0)) for x in (at_a, at_b, off))
        return ids_a, at_a, ids_b, at_b, off

    def align(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """For all texts their links as pair numbers (A's id times the size of B, and B's id), len + 1 offsets of links, the
        digests of the groups, and n_a, n_b, n_groups as columns."""
        ids_a, at_a, ids_b, at_b, off = self.encode(texts)
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        mark = np.zeros(int(off[-1]) + 1, np.int8)
        mark[end_a] = 1
        mark[end_b] += 2
        end = np.flatnonzero(mark)
        kind = mark[end]
        ends_a, ends_b = kind & 1, kind >> 1
        link = ids_a[np.cumsum(ends_a, dtype=np.int64) - ends_a] * self.n_b + ids_b[np.cumsum(ends_b, dtype=np.int64) - ends_b]
        group = end[kind == 3]
        # the place of each token in the list of groups: A's of a group, then B's
        of_a, of_b = np.searchsorted(group, end_a), np.searchsorted(group, end_b)
        before_a, before_b = np.searchsorted(of_a, np.arange(len(group) + 1)), np.searchsorted(of_b, np.arange(len(group) + 1))
        place_a, place_b = np.arange(len(ids_a)) + before_b[of_a], np.arange(len(ids_b)) + before_a[of_b + 1]
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        ids[place_a], ids[place_b] = ids_a, ids_b
        size = self.shown[ids]
        raw, stop = ragged(self.digits, offsets(self.shown)[:-1][ids], size), np.cumsum(size)
        raw[stop[place_a[before_a[1:] - 1]] - 1] = _BAR
        raw[stop[place_b[before_b[1:] - 1]] - 1] = _SEMICOLON
        bound = np.concatenate([[0], stop])[at_a + at_b]
        digests = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bound.tolist(), bound[1:].tolist())]
        counts = np.stack([np.diff(at_a), np.diff(at_b), np.diff(np.searchsorted(group, off, side="right"))], axis=1)
        return link, np.searchsorted(end, off, side="right"), digests, counts


@lru_cache(maxsize=1)
def loaded(*vocabularies: str) -> Pair:
    return Pair(*vocabularies)


def public() -> tuple[str, str, str, str]:
    """The parameters of the vocabularies installed beside Python."""
    import public_tokenizers as p

    return *byte_bpe.public(), p.path("piece_bpe_32k.model")


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers below 2^28 as bytes of seven bits, the lowest first, and how many bytes each takes."""
    x = np.asarray(x, np.int64)
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    at = offsets(size)
    part = np.arange(int(at[-1])) - np.repeat(at[:-1], size)
    raw = (np.repeat(x, size) >> (7 * part)) & 127
    return (raw | np.where(part + 1 < np.repeat(size, size), 128, 0)).astype(np.uint8), size


def from_varints(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.int64)
    start = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    part = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    return np.add.reduceat((raw & np.int64(127)) << (7 * part), start)


SUMS = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_ROWS = "key binary, copies long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, gaps binary, times binary, pair long, place int, links long"
_ARROW = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("gaps", pa.binary()), ("times", pa.binary()), ("pair", pa.int64()), ("place", pa.int32()), ("links", pa.int64())])


def _batch(rows: int, **columns: np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _ARROW], schema=_ARROW)


def _block(number: int, keys: list[bytes], copies: np.ndarray, link: np.ndarray, at: np.ndarray, digests: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of the texts of a block, then those of its pairs."""
    pair, of, seen = np.unique(link, return_inverse=True, return_counts=True)
    order = np.argsort(-seen, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = np.diff(at)
    links = np.bincount(of, weights=np.repeat(copies, n), minlength=len(pair)).astype(np.int64)
    key = np.repeat(np.arange(len(keys)), n) * (len(pair) + 1) + place[of]
    key, times = np.unique(key, return_counts=True)
    text, own = key // (len(pair) + 1), key % (len(pair) + 1)
    gap = own.copy()
    gap[1:] -= np.where(text[1:] == text[:-1], own[:-1], 0)
    bound = np.searchsorted(text, np.arange(len(keys) + 1))
    packed = []
    for values in (gap, times):
        raw, size = varints(values)
        cut = offsets(size)[bound].tolist()
        whole = raw.tobytes()
        packed.append([whole[a:b] for a, b in zip(cut, cut[1:])])
    yield _batch(len(keys), key=keys, copies=copies, block=[number] * len(keys), n_a=counts[:, 0], n_b=counts[:, 1], n_groups=counts[:, 2], n_links=n, groups_sha256=digests, gaps=packed[0], times=packed[1])
    for i in range(0, len(order), 50_000):
        some = order[i : i + 50_000]
        yield _batch(len(some), block=np.full(len(some), number), pair=pair[some], place=np.arange(i, i + len(some)), links=links[some])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """text, copies and key (its digest) of each text that isn't empty."""
    return docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).select("text", "copies", _key())


def _key() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("key")


def blocks(texts: DataFrame, vocabularies: tuple[str, ...], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each text and one for each pair of ids of a block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number, held, parts = loaded(*vocabularies), TaskContext.get().partitionId() << 32, 0, []

        def done() -> Iterator[pa.RecordBatch]:
            keys, copies, link, size, digests, counts = zip(*parts)
            return _block(number, [k for x in keys for k in x], np.concatenate(copies), np.concatenate(link), offsets(np.concatenate(size)), [d for x in digests for d in x], np.concatenate(counts))

        for batch in slices(batches):
            text = column(batch, "text")
            link, at, digests, counts = model.align(text)
            parts.append((column(batch, "key").to_pylist(), ints(column(batch, "copies")), link, np.diff(at), digests, counts))
            held += pc.sum(pc.binary_length(text)).as_py()
            if held >= block_bytes:
                yield from done()
                number, held, parts = number + 1, 0, []
        if parts:
            yield from done()

    return texts.mapInArrow(task, _ROWS)


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """pair, count (links of all documents that hold it) and best (no pair of its id of B has more), from pair rows."""
    counts = written(rows.groupBy("pair").agg(F.sum("links").alias("count")), "pair-counts")
    b = F.expr(f"pair % {n_b}").alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))  # a row for each id of B at most
    return counts.select("pair", "count", b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _summed(key: tuple, texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's texts."""
    order = pairs["place"].to_numpy()
    count, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    count[order], best[order] = pairs["count"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
    raw, off = ws.bytes_of(texts["gaps"].combine_chunks())
    gap, size = from_varints(raw[: off[-1]]), np.cumsum(np.concatenate([[0], raw[: off[-1]] < 128]))[off]
    total = np.cumsum(gap)
    lead = np.concatenate([[0], total])[size[:-1]]
    own = total - np.repeat(lead, np.diff(size))
    raw, off = ws.bytes_of(texts["times"].combine_chunks())
    times = from_varints(raw[: off[-1]])
    sums = {c: np.diff(offsets(times * x[own])[size]) for c, x in (("n_best", best), ("count_sum", count))}
    columns = [f.split()[0] for f in SUMS.split(", ")]
    return pa.table({c: pa.array(sums[c]) if c in sums else texts[c] for c in columns})


def measured(docs: DataFrame, vocabularies: tuple[str, ...] | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """doc_id, the measures and groups_sha256 of each document; and pair, count and best of all id pairs (A's id times B's
    size, and B's id)."""
    vocabularies = vocabularies or public()
    texts = distinct_texts(docs)
    rows = written(blocks(texts, vocabularies, block_bytes), "aligned")
    pairs = rows.where("pair is not null").select("block", "pair", "place", "links")
    counts = written(pair_counts(pairs, sentencepiece.SentencePieceProcessor(model_file=vocabularies[-1]).get_piece_size()), "pairs")
    known = pairs.select("block", "pair", "place").join(counts, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    own = rows.where("key is not null").drop("pair", "place", "links")
    return own.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_summed, SUMS), counts


def aligned(docs: DataFrame, vocabularies: tuple[str, ...] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, the measures and groups_sha256 of each document."""
    sums = written(measured(docs, vocabularies, block_bytes)[0], "measures")
    ids = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text") != "", _key()).alias("key")), "texts-of-documents")
    has, names = ids.where("key is not null"), (*MEASURES, "groups_sha256")
    found = join_counted(has, sums, "key", "copies", has.count()).select("doc_id", *names)
    zeros = [F.lit(0).cast("long").alias(c) for c in MEASURES]
    return found.unionByName(ids.where("key is null").select("doc_id", *zeros, F.lit("").alias("groups_sha256")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
