"""Packing token ids into training sequences by bounded-space online best fit.

Each task reads its partition once, keeping at most `open_windows` unfinished windows:

* a document's ids (its end id included) are cut at every `length` ids; full pieces are sequences of their own,
* the rest goes into the open window that it leaves the least room in,
* where none has room, the fullest window is closed and leaves; if its room is at least `least_piece`, the rest is
  cut there first, and what remains of it opens a new window.

A partition ends with at most `open_windows` windows. They are leftovers; they are dealt into groups of about
`group_windows`, and each group merges its own by first fit, longest first. Memory is bounded by one slice of
texts, the open windows and one such group. Nothing is dropped; every id lies in one piece.

Nulls: a null text is an empty one (its end id alone); a null doc_id is kept as null. Equal and repeated rows are
packed each on its own. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe
from marginalia.llm.common import column, slices, written

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, closed boolean, filled long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()), ("closed", pa.bool_()), ("filled", pa.int64()), ("ids", pa.binary())])


class Windows:
    """The open windows of one task, and the pieces of those that are closed."""

    def __init__(self, length: int, open_windows: int, least_piece: int, first: int):
        self.length, self.most, self.least, self.next = length, open_windows, least_piece, first
        self.room: list[tuple[int, int]] = []  # (room, window), ascending
        self.pieces: dict[int, list[list]] = {}
        self.done: list[list] = []

    def close(self, window: int, closed: bool = True) -> None:
        pieces = self.pieces.pop(window)
        filled = sum(p[2] for p in pieces)
        self.done += [[*p[:5], window, p[5], closed, filled, p[6]] for p in pieces]

    def put(self, window: int, room: int, piece: list) -> None:
        """piece: doc_id, start, length, crc, tokens, ids."""
        self.pieces.setdefault(window, []).append([*piece[:5], self.length - room, piece[5]])
        if room == piece[2]:
            self.close(window)
        else:
            insort(self.room, (room - piece[2], window))

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc_id: int | None, ids: np.ndarray, stored: np.ndarray) -> None:
        total = len(ids)

        def piece(a: int, b: int) -> list:
            return [doc_id, a, b - a, zlib.crc32(ids[a:b]), total, stored[a:b].tobytes()]

        at = 0
        while total - at >= self.length:
            self.put(self.new(), self.length, piece(at, at + self.length))
            at += self.length
        while at < total:
            fit = bisect_left(self.room, (total - at, -1))
            if fit < len(self.room):
                self.put(*reversed(self.room.pop(fit)), piece(at, total))
                return
            if len(self.room) < self.most:
                self.put(self.new(), self.length, piece(at, total))
                return
            room, window = self.room.pop(0)
            if room >= self.least:
                self.put(window, room, piece(at, at + room))
                at += room
            else:
                self.close(window)

    def taken(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)


def windows_of(docs: DataFrame, vocabulary: tuple[str, str, str], length: int, end_id: int, open_windows: int, least_piece: int) -> DataFrame:
    """A row for each piece; windows with `closed` false are the leftovers of their partition."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.loaded(*vocabulary)
        kept = Windows(length, open_windows, least_piece, TaskContext.get().partitionId() << 32)
        for batch in slices(batches):
            ids, at = bpe.encode(column(batch, "text"))
            n = batch.num_rows
            ids = np.insert(ids, at[1:], np.uint32(end_id))
            at = at + np.arange(n + 1)
            stored = ids.astype("<u2") if bpe.size.size < 1 << 16 else ids.astype("<u4")
            for i, doc_id in enumerate(column(batch, "doc_id").to_pylist()):
                kept.add(doc_id, ids[at[i] : at[i + 1]], stored[at[i] : at[i + 1]])
            yield kept.taken()
        for window in list(kept.pieces):
            kept.close(window, closed=False)
        yield kept.taken()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, SCHEMA)


def merged(left: DataFrame, length: int, group_windows: int) -> DataFrame:
    """window, sequence_id and base of each leftover window: first fit, longest first, within a group."""
    count = left.select("window", "filled").distinct()
    groups = max(1, math.ceil(count.count() / group_windows))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        window, filled = rows["window"].to_numpy(), rows["filled"].to_numpy()
        order = np.lexsort((window, -filled))
        number, base, used = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros(0, np.int64)
        for i in order:
            fits = np.flatnonzero(used + filled[i] <= length)
            if not len(fits):
                used = np.append(used, 0)
                fits = [len(used) - 1]
            number[i], base[i] = fits[0], used[fits[0]]
            used[fits[0]] += filled[i]
        return pa.table({"window": window, "sequence_id": (np.int64(1) << 62) + (np.int64(key[0].as_py()) << 32) + number, "base": base})

    return count.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(groups)).cast("int")).groupBy("part").applyInArrow(pack, "window long, sequence_id long, base long")


def pack(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, length: int = 1024, end_id: int = 0, open_windows: int = 32, least_piece: int = 16, group_windows: int = 4096) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ids: little-endian unsigned 16-bit integers (32-bit for vocabularies over 65,535). The pieces are written once
    to the shared folder, so the texts are read and encoded once; only leftovers are shuffled."""
    vocabulary = vocabulary or byte_bpe.public()
    pieces = written(windows_of(docs, vocabulary, length, end_id, open_windows, least_piece), "pieces")
    left = pieces.where(~F.col("closed"))
    placed = left.drop("filled").join(merged(left, length, group_windows), "window").withColumn("offset", F.col("offset") + F.col("base"))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
    return pieces.where("closed").withColumn("sequence_id", F.col("window")).select(*names).unionByName(placed.select(*names))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")  # as it is split: fewer tasks leave fewer windows
