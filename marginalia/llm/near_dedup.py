"""Near-duplicate groups by SimHash, with Golay-code fuzzy hashing for the search.

Fingerprints. Words of the text (A-Z lowered) in 4-word shingles, XXH64 of each; a bit of the fingerprint is set if it
is set in over half of the shingles.

Search. Only distinct fingerprints are searched. A fingerprint is cut into segments A (23 bits), B (23) and C (18,
padded to 23). Up to 4 differing bits fall on three segments, so leaving out the one with most of them, the other two
have at most 2 together: 0 and up to 2, or 1 and 1.

* 0 and 2: one segment whole, with each of the (1 or 6) Golay indices of the other;
* 1 and 1: of each of the two, one half is whole; these two halves, with each Golay index of the third segment, which
  then has at most 2 as well.

That is at most 108 keys of about 30 bits or more for each fingerprint. Fingerprints that share a key are compared in
full (the join and the check). A key's group is not expanded into pairs: stars around pivots are linked first, and
then only stars that are not yet connected are compared, so a group gives fewer links than it has members and no
connection is lost. A group of over `group_limit` fingerprints is cut into blocks, and pairs of blocks are compared
as tasks of their own.

Links become components by star joins; every row gets its fingerprint's least doc_id.

Nulls: a null text has no words, so fingerprint zero, and is linked like any other. A null doc_id is kept; a component
of null ids alone has a null component_id. Rows of one doc_id count each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import golay
from marginalia.llm import wordspans as ws
from marginalia.llm.common import column, ints, slices, table, written
from marginalia.operators.components import components, join_counted

SEED, SHINGLE, BITS = 42, 4, 4


def simhashes(array: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    buf, off = ws.bytes_of(array)
    n = int(off[-1])
    buf = buf.copy()
    buf[:n][(buf[:n] >= 65) & (buf[:n] <= 90)] += 32
    start, end, doc = ws.spans(buf, off)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(start):
        return out
    # one space between the words of a text: the last white byte before each word, and none before the first
    keep = ~ws.WHITE[buf[:n]]
    first = np.ones(len(start), bool)
    first[1:] = doc[1:] != doc[:-1]
    keep[start[~first] - 1] = True
    raw = np.where(ws.WHITE[buf[:n]], 32, buf[:n]).astype(np.uint8)[keep].tobytes()
    place = np.cumsum(keep)
    start, end = place[start] - 1, place[end - 1]
    bound = ws.per_document(doc, len(off) - 1)
    words = np.diff(bound)
    has = np.flatnonzero(words)
    count = np.maximum(words[has] - shingle + 1, 1)
    at = np.cumsum(count) - count
    begin = np.repeat(bound[has] - at, count) + np.arange(int(count.sum()))
    stop = np.minimum(begin + shingle, np.repeat(bound[has + 1], count)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.empty(len(begin), np.uint64)
    for i in range(0, len(h), 50_000):  # Python's integers take four times the room
        part = slice(i, i + 50_000)
        h[part] = [digest(raw[a:b], SEED) for a, b in zip(start[begin[part]].tolist(), end[stop[part]].tolist())]
    sums = np.zeros((len(has), 64), np.int64)
    for byte in range(8):  # a byte at a time, to bound memory
        bits = np.unpackbits(((h >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        sums[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    over = 2 * sums > count[:, None]
    out[has] = np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(simhashes(column(batch, "text")).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, fp long")


def _parts(fp: np.ndarray) -> list[tuple[np.ndarray, int]]:
    low = lambda shift, width: ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
    return [(low(0, 23), 23), (low(23, 23), 23), (low(46, 18), 18)]


def search_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the row of fp that each belongs to. A key holds its kind, so keys of two kinds never meet."""
    parts = _parts(fp)
    near = [golay.keys(x).astype(np.int64) for x, _ in parts]
    new = [np.concatenate([np.ones((len(fp), 1), bool), k[:, 1:] != k[:, :1]], axis=1) for k in near]
    out, kind = [], 0

    def put(exact: np.ndarray, third: int) -> None:
        nonlocal kind
        row, col = np.nonzero(new[third])
        out.append((np.int64(kind) << 58 | exact[row] << 12 | near[third][row, col], row))
        kind += 1

    for i in range(3):
        for j in range(3):
            if i != j:
                put(parts[i][0], j)
    for i, j, third in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        (x, wx), (y, wy) = parts[i], parts[j]
        for lower_x in (True, False):
            for lower_y in (True, False):
                hx = x & ((1 << wx // 2) - 1) if lower_x else x >> wx // 2
                hy = y & ((1 << wy // 2) - 1) if lower_y else y >> wy // 2
                put(hx << 12 | hy, third)
    return np.concatenate([k for k, _ in out]), np.concatenate([r for _, r in out])


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def forest(fp: np.ndarray, bits: int = BITS, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v), each within `bits`, that connect whatever the links between all of fp connect.

    other: only links between fp and other are needed; those within either may be used all the same."""
    fp = fp if other is None else np.concatenate([fp, other])
    star, us, vs, pivots = np.full(len(fp), -1), [], [], []
    left = np.arange(len(fp))
    while len(left):
        p = left[0]
        hit = _near(fp[left], fp[p], bits)
        star[left[hit]] = len(pivots)
        mine = left[hit][1:]
        us.append(np.repeat(fp[p], len(mine)))
        vs.append(fp[mine])
        pivots.append(p)
        left = left[~hit]
    members = np.split(np.argsort(star, kind="stable"), np.cumsum(np.bincount(star))[:-1])
    parent = list(range(len(pivots)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    centre = fp[np.array(pivots, np.int64)]
    for i in range(len(pivots)):
        # members of two stars can only be near if the pivots are within three times the distance
        for j in np.flatnonzero(_near(centre[i + 1 :], centre[i], 3 * bits)) + i + 1:
            if root(i) == root(j):
                continue
            b = fp[members[j]]
            step = max(1, (1 << 20) // len(b))
            for at in range(0, len(members[i]), step):
                a = fp[members[i][at : at + step]]
                hit = np.argwhere(_near(a[:, None], b[None, :], bits))
                if len(hit):
                    us.append(a[hit[0][:1]])
                    vs.append(b[hit[0][1:]])
                    parent[root(i)] = root(j)
                    break
    return np.concatenate(us), np.concatenate(vs)


def _links(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links within the groups of equal keys; rows are sorted by key."""
    bound = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(bound)
    us, vs = [], []
    for d in range(1, 8):  # groups of up to 8: each with the d-th after it
        i = np.flatnonzero(size > d)
        i = i[size[i] <= 8]
        if not len(i):
            continue
        n = size[i] - d
        a = np.repeat(bound[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        hit = a[_near(fp[a], fp[a + d], bits)]
        us.append(fp[hit])
        vs.append(fp[hit + d])
    for i in np.flatnonzero(size > 8):
        u, v = forest(fp[bound[i] : bound[i + 1]], bits)
        us.append(u)
        vs.append(v)
    return us, vs


_EDGES = "u long, v long, key long, block binary"


def links(nodes: DataFrame, bits: int = BITS, group_limit: int = 1 << 16) -> DataFrame:
    """u, v: links between distinct fingerprints that give the components of all links within `bits`."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = ints(column(batch, "fp")).view(np.uint64)
            for at in range(0, len(fp), 5000):
                key, row = search_keys(fp[at : at + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at : at + 5000][row].view(np.int64))], names=["key", "fp"])

    def rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0).view(np.int64) if len(u) else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(pair))
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), none.cast(pa.int64()), none.cast(pa.binary())], names=["u", "v", "key", "block"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of a key follow each other; what may go on in the next batch waits. Blocks of a large group leave as rows."""
        key, fp, cut = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def block(k: int, members: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(1).cast(pa.int64()), pa.nulls(1).cast(pa.int64()), pa.array([k], pa.int64()), pa.array([members.tobytes()], pa.binary())], names=["u", "v", "key", "block"])

        for batch in batches:
            key = np.concatenate([key, ints(column(batch, "key"))])
            fp = np.concatenate([fp, ints(column(batch, "fp")).view(np.uint64)])
            if not len(key):
                continue
            end = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
            if end:
                if cut is not None and key[0] == cut:  # the last block of a large group
                    stop = int(np.searchsorted(key != cut, True))
                    yield block(cut, fp[:stop])
                    key, fp, end = key[stop:], fp[stop:], end - stop
                cut = None
                us, vs = _links(key[:end], fp[:end], bits) if end else ([], [])
                if us:
                    yield rows(np.concatenate(us), np.concatenate(vs))
                key, fp = key[end:], fp[end:]
            while len(key) > group_limit:
                cut = int(key[0])
                yield block(cut, fp[:group_limit])
                key, fp = key[group_limit:], fp[group_limit:]
        if len(key):
            if cut is not None and key[0] == cut:
                yield block(cut, fp)
            else:
                us, vs = _links(key, fp, bits)
                if us:
                    yield rows(np.concatenate(us), np.concatenate(vs))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist()):
                u, v = forest(np.frombuffer(a, np.uint64), bits, None if a == b else np.frombuffer(b, np.uint64))
                yield rows(u, v).select(["u", "v"])

    # few narrow rows become many: dealt out by number alone, since by fp they lie in a few coalesced partitions already
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wide = nodes.select("fp").repartition(tasks)
    found = written(wide.mapInArrow(spread, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(meet, _EDGES), "links")
    blocks = found.where("key is not null").select("key", "block", F.xxhash64("block").alias("id"))
    two = blocks.select("key", F.col("block").alias("a"), F.col("id").alias("ia")).join(blocks.select("key", F.col("block").alias("b"), F.col("id").alias("ib")), "key").where("ia <= ib")
    large = two.repartition(F.col("ia"), F.col("ib")).select("a", "b").mapInArrow(pairs, "u long, v long")
    return found.where("key is null").select("u", "v").union(large)


def near_groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links of up to `bits` differing bits) of each row."""
    prints = written(fingerprints(docs), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    group = components(links(nodes, bits)).withColumnRenamed("node", "fp")
    members = written(nodes.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "members")
    ids = members.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    named = written(join_counted(members, ids, "component", "nodes", members.count()).select("fp", "component_id", "rows"), "named")
    return join_counted(prints, named, "fp", "rows", prints.count()).select("doc_id", "fp", "component_id")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
