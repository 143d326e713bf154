"""Token ids as shard files of raw ids, with a minimal perfect hash index for access by document key.

Files, under one folder:

* `ids-NNNNNNNN.bin`: the ids of a range of documents in ascending doc_id order, nothing else (little-endian
  unsigned 16-bit integers, 32-bit for vocabularies over 65,535);
* `index-NNNNN.bin`: for the keys that hash to this number, a minimal perfect hash and, by slot, the key's 32-bit
  fingerprint, shard, offset and length in ids.

A lookup hashes the key to an index file, then to a slot, compares the fingerprint and reads one range of one shard.

Work: documents are range-partitioned by doc_id (one shuffle of the texts), each task encodes its range and writes
its shard; keys with their places go to the index files by hash. A retried task writes the same bytes to a name of
its own and then renames it, or leaves the file that a lost task has renamed already. Files go through pyarrow's file systems, so the folder may be any shared store.

Nulls: a null text is empty (its end id alone). A null doc_id is stored first, under the key -2**63. Rows of one
doc_id are stored next to each other, in order of their text; the key leads to all of them, and the lengths kept
with the key tell them apart. An empty table writes no shard. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import byte_bpe
from marginalia.llm.common import column, ints, new_path, offsets, slices, table, written
from marginalia.llm.mph import Mph, fingerprints

NO_KEY = -(2**63)
ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("length", "<i8"), ("rows", "<i4")])
PLACES = "doc_id long, shard int, offset long, n_tokens long"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _settle(fs: pafs.FileSystem, part: str, name: str) -> None:
    """A finished file gets its name. Stores differ in whether a move replaces a file, so where a lost task has already
    left the same file there, this copy goes instead."""
    there = fs.get_file_info(name)
    if there.type == pafs.FileType.File:
        if there.size == fs.get_file_info(part).size:
            fs.delete_file(part)
            return
        fs.delete_file(name)
    try:
        fs.move(part, name)
    except OSError:  # another attempt of this task was faster
        if fs.get_file_info(name).type != pafs.FileType.File:
            raise
        fs.delete_file(part)


def _put(folder: str, name: str, parts: list[bytes]) -> None:
    fs, root = _store(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    _settle(fs, part, f"{root}/{name}")


def write_shards(docs: DataFrame, folder: str, vocabulary: tuple[str, str, str], end_id: int, partitions: int) -> DataFrame:
    """Writes the shards; returns doc_id (null as NO_KEY), shard, offset and n_tokens of each row, in order."""
    width = "<u2" if byte_bpe.loaded(*vocabulary).size.size < 1 << 16 else "<u4"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, shard, done = byte_bpe.loaded(*vocabulary), TaskContext.get().partitionId(), 0
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        name, part, out = f"{root}/ids-{shard:08d}.bin", f"{root}/.ids-{shard:08d}.{uuid.uuid4().hex}", None
        for batch in slices(batches):
            ids, at = bpe.encode(column(batch, "text"))
            ids = np.insert(ids, at[1:], np.uint32(end_id)).astype(width)
            at = at + np.arange(batch.num_rows + 1)
            out = out or fs.open_output_stream(part)
            out.write(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ints(column(batch, "doc_id"), NO_KEY)), pa.array(np.full(batch.num_rows, shard, np.int32)), pa.array(done + at[:-1]), pa.array(np.diff(at))], names=["doc_id", "shard", "offset", "n_tokens"])
            done += len(ids)
        if out:
            out.close()
            _settle(fs, part, name)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return ordered.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(task, PLACES)


def write_index(places: DataFrame, folder: str, files: int) -> int:
    """Writes the index files; returns how many keys they hold."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        got = {n: rows[n].to_numpy() for n in ("doc_id", "shard", "offset", "n_tokens")}
        order = np.lexsort((got["offset"], got["doc_id"]))
        keys, first, count = np.unique(got["doc_id"][order], return_index=True, return_counts=True)
        mph = Mph.build(keys.view(np.uint64))
        entry = np.zeros(len(keys), ENTRY)
        slot = mph.slots(keys.view(np.uint64))
        entry["fingerprint"][slot] = fingerprints(keys.view(np.uint64))
        for name in ("shard", "offset"):
            entry[name][slot] = got[name][order][first]
        entry["length"][slot] = np.add.reduceat(got["n_tokens"][order], first)
        entry["rows"][slot] = count
        # lengths of rows that share a key, by slot, so that the run can be told apart
        again = np.flatnonzero(count > 1)
        lengths = {int(slot[i]): got["n_tokens"][order][first[i] : first[i] + count[i]].tolist() for i in again}
        _put(folder, f"index-{number:05d}.bin", [mph.dump(), entry.tobytes(), json.dumps(lengths).encode()])
        return pa.table({"keys": pa.array([len(keys)], pa.int64())})

    done = places.withColumn("file", F.pmod(F.xxhash64("doc_id"), F.lit(files)).cast("int")).groupBy("file").applyInArrow(task, "keys long")
    return done.agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0]


class Index:
    """One index file in memory."""

    def __init__(self, folder: str, number: int):
        fs, root = _store(folder)
        with fs.open_input_stream(f"{root}/index-{number:05d}.bin") as f:
            raw = f.read()
        self.mph, at = Mph.load(raw)
        self.entry = np.frombuffer(raw, ENTRY, self.mph.total, at)
        self.lengths = {int(k): v for k, v in json.loads(raw[at + self.entry.nbytes :]).items()}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the keys found, and which those are; a slot whose fingerprint differs is no hit."""
        slot = self.mph.slots(keys.view(np.uint64))
        if not self.mph.total:
            return slot[:0], np.zeros(len(keys), bool)
        hit = (slot >= 0) & (self.entry["fingerprint"][slot] == fingerprints(keys.view(np.uint64)))
        return slot[hit], hit


def look_up(keys: DataFrame, folder: str, files: int) -> DataFrame:
    """doc_id, shard, offset and n_tokens of each row stored under the (distinct) keys, by the index files alone."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        index, asked = Index(folder, key[0].as_py()), np.unique(ints(rows["doc_id"].combine_chunks(), NO_KEY))
        slot, hit = index.find(asked)
        found, entry = asked[hit], index.entry[slot]
        many = np.flatnonzero(entry["rows"] > 1)
        one = entry["rows"] == 1
        out = [found[one], entry["shard"][one].astype(np.int32), entry["offset"][one], entry["length"][one]]
        for i in many:
            n = np.array(index.lengths[int(slot[i])], np.int64)
            out = [np.concatenate(x) for x in zip(out, [np.full(len(n), found[i]), np.full(len(n), entry["shard"][i], np.int32), entry["offset"][i] + offsets(n)[:-1], n])]
        return pa.table(dict(zip(("doc_id", "shard", "offset", "n_tokens"), map(pa.array, out))))

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_KEY))
    return keys.select(key.alias("doc_id")).withColumn("file", F.pmod(F.xxhash64("doc_id"), F.lit(files)).cast("int")).groupBy("file").applyInArrow(task, PLACES)


def read_back(found: DataFrame, folder: str, width: str = "<u2", most: int = 8 << 20, tasks: int = 0) -> DataFrame:
    """The places with ids (binary, as stored), read from the shards: tasks take whole shards, neighbours in one read.

    tasks: how many share the shards (else as the session sets); places are narrow, so their bytes don't tell."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        opened, current, unit = None, None, np.dtype(width).itemsize
        for batch in batches:
            shard, offset, size = (ints(column(batch, n)) for n in ("shard", "offset", "n_tokens"))
            at = 0
            while at < batch.num_rows:
                end = at + 1
                while end < batch.num_rows and shard[end] == shard[at] and offset[end] == offset[end - 1] + size[end - 1] and (offset[end] + size[end] - offset[at]) * unit <= most:
                    end += 1
                if shard[at] != current:
                    if opened:
                        opened.close()
                    opened, current = fs.open_input_file(f"{root}/ids-{shard[at]:08d}.bin"), shard[at]
                raw = opened.read_at(int(offset[end - 1] + size[end - 1] - offset[at]) * unit, int(offset[at]) * unit)
                cut = (offset[at:end] - offset[at]) * unit
                ids = pa.array([raw[a : a + n] for a, n in zip(cut.tolist(), (size[at:end] * unit).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, ids], names=[*batch.schema.names, "ids"])
                at = end
        if opened:
            opened.close()

    schema = T.StructType([*found.schema.fields, T.StructField("ids", T.BinaryType())])
    return (found.repartition(tasks, "shard") if tasks else found.repartition("shard")).sortWithinPartitions("shard", "offset").mapInArrow(task, schema)


class Store:
    """A written folder. starts: the ids before each shard (one number a shard, so as many as tasks that wrote)."""

    def __init__(self, folder: str, files: int, width: str, starts: dict[int, int], n_keys: int, places: DataFrame):
        self.folder, self.files, self.width, self.starts, self.n_keys, self.places = folder, files, width, starts, n_keys, places

    def get(self, keys: DataFrame) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens and ids of every row under these keys."""
        spark = keys.sparkSession
        starts = spark.createDataFrame(pd.DataFrame({"shard": pd.array(list(self.starts), "int32"), "base": pd.array(list(self.starts.values()), "int64")}), "shard int, base long")
        found = look_up(keys, self.folder, self.files).join(starts, "shard").withColumn("start", F.col("base") + F.col("offset"))
        return read_back(found, self.folder, self.width, tasks=len(self.starts)).select(F.nullif("doc_id", F.lit(NO_KEY)).alias("doc_id"), "start", "n_tokens", "ids")


def store(docs: DataFrame, folder: str | None = None, vocabulary: tuple[str, str, str] | None = None, end_id: int = 2, partitions: int | None = None, keys_per_file: int = 1_000_000) -> Store:
    spark = docs.sparkSession
    vocabulary, folder = vocabulary or byte_bpe.public(), folder or new_path(spark, "token-store")
    partitions = partitions or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = written(write_shards(docs, folder, vocabulary, end_id, partitions), "places")
    sums = sorted((r["shard"], r["n"], r["k"]) for r in places.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect())
    starts = dict(zip((s[0] for s in sums), offsets(np.array([s[1] for s in sums], np.int64))[:-1].tolist()))
    files = max(8, -(-sum(s[2] for s in sums) // keys_per_file))
    n_keys = write_index(places, folder, files)
    return Store(folder, files, "<u2" if byte_bpe.loaded(*vocabulary).size.size < 1 << 16 else "<u4", starts, n_keys, places)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = store(docs)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x, made_width).astype("<u4")) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    made_width = made.width
    return made.get(docs.select("doc_id")).mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
