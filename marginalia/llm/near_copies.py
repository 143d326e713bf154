"""Near copies by the Jaccard similarity of 5-word shingles: SimHash and MinHash for the search, exact checks.

Nodes. Words (A-Z lowered) in 5-word shingles, a 64-bit hash of each (a text of fewer words is one shingle); rows whose
texts have the same set of shingles are one node. A row is known by its doc_id and a hash of all its columns, so rows
that share a doc_id, or have none, are told apart; rows alike in all columns are one.

Search. First the SimHash fingerprints of these shingles, which meet as in `near_dedup` (Golay indices of segments,
pigeonhole): texts within 4 bits are candidates. Texts of similarity 0.8 differ by some ten of 64 bits, more than that
search can bridge, so MinHash adds the rest: `BANDS` keys of `ROWS` minima each, of which two texts of similarity 0.8
miss all with probability (1 - 0.8^5)^25 = 0.00005, more alike ones with less. Nodes that share a key are candidates.

Check. Nodes are linked if their sets share at least `LEAST` fifths of their union. Pairs of SimHash and of groups of up to
`SMALL` nodes are joined with both sets. Larger groups are dealt into blocks of at most `BLOCK` nodes and `SHINGLES`
shingles, and checked within tasks, where only links come out:

* a pair is looked at under one key alone, the first that its nodes share;
* nodes that are connected already are not compared, and within a task each link connects more;
* similarity is first estimated from a byte of each of `SKETCH` further minima: a pair needs `AGREE` equal bytes (of
  similarity 0.8, a pair has fewer with probability 0.000002), the others are checked on their sets.

First each block is compared with itself. Then, for groups of several blocks, one node of each component, blocks of these
with each other; then the nodes of groups that are still in several components, block with block, but for the pairs of those
that were compared before. So a large group of copies that are all alike costs little more than its blocks alone, and no
pair that shares a key is left out.

Links become components by star joins; of each the row with the least doc_id stays (nulls last).

Nulls: a null text, or one without words, is the empty set, and all of those are one node. A null doc_id is kept as it
is. An empty table gives no rows. All columns of the input are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import near_dedup
from marginalia.llm import wordspans as ws
from marginalia.llm.common import column, fresh, ints, offsets, ragged, slices, written
from marginalia.llm.substring_dedup import window_hashes
from marginalia.operators.components import components

SHINGLE, BANDS, ROWS, LEAST, SMALL = 5, 25, 5, 4, 8
SKETCH, AGREE, BLOCK, SHINGLES = 512, 368, 1024, 2 << 20
_SEEDS = np.random.default_rng(42).integers(0, 2**64, (BANDS * ROWS + SKETCH, 2), dtype=np.uint64) | np.array([0, 1], np.uint64)


def shingle_sets(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, and len + 1 bounds."""
    array = pc.ascii_lower(pc.fill_null(array, ""))
    h, of, _, (_, _, _, _, bound) = window_hashes(array, SHINGLE)
    words = np.diff(bound)
    for n in range(1, SHINGLE):  # short texts: all their words
        rows = np.flatnonzero(words == n)
        if len(rows):
            h, of = np.concatenate([h, window_hashes(array.take(pa.array(rows)), n)[0]]), np.concatenate([of, rows])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.searchsorted(of[new], np.arange(len(array) + 1))


def _minima(h: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> Iterator[np.ndarray]:
    for flip, times in seeds:
        yield np.minimum.reduceat((h ^ flip) * times, at)


def sketches(h: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node of each set and its keys (for the empty set: zeros)."""
    node, keys = np.zeros(len(bound) - 1, np.uint64), np.zeros((len(bound) - 1, BANDS), np.uint64)
    has = np.flatnonzero(np.diff(bound))
    if not len(has):
        return node, keys
    at = bound[has]
    node[has] = ws.mixed(np.add.reduceat(ws.mixed(h), at) ^ np.diff(bound)[has].astype(np.uint64))
    for band in range(BANDS):
        key = np.full(len(has), band, np.uint64)
        for least in _minima(h, at, _SEEDS[band * ROWS : (band + 1) * ROWS]):
            key = ws.mixed(key + least)
        keys[has, band] = key
    return node, keys


def estimates(h: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A byte of each of SKETCH minima of each set; the sets aren't empty."""
    out = np.zeros((len(bound) - 1, SKETCH), np.uint8)
    for i, least in enumerate(_minima(h, bound[:-1], _SEEDS[BANDS * ROWS :])):
        out[:, i] = ws.mixed(least) & np.uint64(255)
    return out


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, row (with doc_id: the row's key), node, its number of shingles, fp and keys of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = column(batch, "text")
            h, bound = shingle_sets(text)
            node, keys = sketches(h, bound)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).reshape(-1)))
            fp = near_dedup.simhashes(text, SHINGLE)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "row"), pa.array(node.view(np.int64)), pa.array(np.diff(bound)), pa.array(fp.view(np.int64)), lists], names=["doc_id", "row", "node", "n", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), "text").mapInArrow(task, "doc_id long, row long, node long, n long, fp long, keys array<long>")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: all pairs of the small groups, and the rows of the large ones with the group's size and all its
    nodes' shingles."""

    def groups(key: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.repeat(np.diff(cut), np.diff(cut))
        last = np.repeat(cut[1:], np.diff(cut))
        us, vs = [], []
        for d in range(1, SMALL):
            i = np.flatnonzero((size <= SMALL) & (np.arange(len(key)) + d < last))
            us.append(node[i])
            vs.append(node[i + d])
        pair = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0)
        big = size > SMALL
        shingles = np.repeat(np.add.reduceat(n, cut[:-1]), np.diff(cut))
        pairs, none = len(pair), np.zeros(int(big.sum()), np.int64)
        columns = [np.concatenate([pair[:, 0], node[big]]), np.concatenate([pair[:, 1], none]), *(np.concatenate([np.zeros(pairs, np.int64), x[big]]) for x in (key, size, shingles))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["u", "v", "key", "size", "shingles"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [ints(column(batch, c)) for c in ("key", "node", "n")]
        k = now[0]
        if not len(k):
            continue
        start = int(np.searchsorted(k, k[-1]))  # the last group may go on
        if start or (held and held[-1][0][-1] != k[0]):
            yield groups(*map(np.concatenate, zip(*held, [x[:start] for x in now])))
            held = [[x[start:] for x in now]]
        else:
            held.append(now)
    if held:
        yield groups(*map(np.concatenate, zip(*held)))


def _sets(docs: DataFrame, first: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its shingles, in ascending order, and for those that are `large` the bytes of its minima; nodes: node, large."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, bound = shingle_sets(column(batch, "text"))
            large = np.flatnonzero(column(batch, "large").to_numpy(zero_copy_only=False))
            minima = [None] * batch.num_rows
            if len(large):
                size = np.diff(bound)[large]
                for i, m in zip(large.tolist(), estimates(ragged(h, bound[:-1][large], size), offsets(size))):
                    minima[i] = m.tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(h.view(np.int64))), pa.array(minima, pa.binary())], names=["node", "set", "minima"])

    rows = first.join(nodes, "node").select("node", "large", F.col("first.doc_id").alias("of"), F.col("first.row").alias("row"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("hash"), "text")
    found = text.join(rows, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("row"))).select("node", "large", "text")
    return found.mapInArrow(task, "node long, set array<long>, minima binary").dropDuplicates(["node"])


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets share at least LEAST fifths of their union."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where((5 * F.least(F.size("a"), F.size("b")) >= LEAST * F.greatest(F.size("a"), F.size("b"))) & (5 * shared >= LEAST * (F.size("a") + F.size("b") - shared))).select("u", "v")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (ascending) share at least LEAST fifths of their union."""
    if 5 * min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 5 * shared >= LEAST * (len(a) + len(b) - shared)


class Group:
    """Nodes of one key's group that meet in a task."""

    def __init__(self, rows: pa.Table):
        self.node, self.component = rows["node"].to_numpy(), rows["component"].to_numpy()
        self.minima = np.frombuffer(b"".join(rows["minima"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        sets, keys = (rows[c].combine_chunks() for c in ("set", "keys"))
        self.pool, self.bound = sets.flatten().to_numpy().view(np.uint64), offsets(pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64))
        self.keys = keys.flatten().to_numpy().reshape(rows.num_rows, -1)
        self.block, self.met = rows["block"].to_numpy(), rows["met"].to_numpy(zero_copy_only=False)

    def set_of(self, i: int) -> np.ndarray:
        return self.pool[self.bound[i] : self.bound[i + 1]]

    def candidates(self, key: int, a: int, b: int, least: int = AGREE) -> np.ndarray:
        """Pairs of places, the likeliest first: of blocks a and b (or within one), in two components, not met before, with
        enough equal minima, and with this key the first that they share."""
        left, right = np.flatnonzero(self.block == a), np.flatnonzero(self.block == b)
        out, score = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
        theirs = np.ascontiguousarray(self.minima[right].T)
        step = max(1, (1 << 20) // max(1, len(right)))
        for at in range(0, len(left), step):
            mine = left[at : at + step]
            agree = np.zeros((len(mine), len(right)), np.uint16)
            for i, column_ in enumerate(theirs):
                agree += self.minima[mine, i][:, None] == column_
            agree[(self.component[mine][:, None] == self.component[right]) | (self.met[mine][:, None] & self.met[right])] = 0
            if a == b:
                agree[mine[:, None] >= right] = 0
            i, j = np.nonzero(agree >= least)
            shared = self.keys[mine[i]] == self.keys[right[j]]
            first = self.keys[mine[i], shared.argmax(axis=1)] == key if len(i) else np.zeros(0, bool)
            out.append(np.stack([mine[i[first]], right[j[first]]], axis=1))
            score.append(agree[i[first], j[first]].astype(np.int64))
        return np.concatenate(out)[np.argsort(-np.concatenate(score), kind="stable")]

    def links(self, key: int, a: int, b: int, least: int = AGREE) -> np.ndarray:
        """Nodes that are alike, as pairs that connect whatever the alike candidates connect."""
        _, own = np.unique(self.component, return_inverse=True)
        parent = list(range(len(self.component)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out, label = [], own.tolist()
        for i, j in self.candidates(key, a, b, least).tolist():
            x, y = root(label[i]), root(label[j])
            if x != y and alike(self.set_of(i), self.set_of(j)):
                parent[x] = y
                out.append((self.node[i], self.node[j]))
        return np.array(out, np.int64).reshape(-1, 2)


def _blocked(rows: DataFrame) -> DataFrame:
    """rows (key, size, shingles, ...) with the block that each falls in at random, and the group's number of blocks."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / SHINGLES)).cast("int")
    return rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))


def _block_links(rows: DataFrame, across: bool) -> DataFrame:
    """u, v: links of each block's nodes with each other or, across, with those of every other block of the group."""

    def task(key: tuple, table: pa.Table) -> pa.Table:
        pair = Group(table).links(*(x.as_py() for x in key))
        return pa.table({"u": pair[:, 0], "v": pair[:, 1]})

    a, b = F.col("block"), F.col("block")
    if across:
        rows = rows.withColumn("with", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))))
        a, b = F.least("block", "with"), F.greatest("block", "with")
    return rows.withColumns({"a": a, "b": b}).groupBy("key", "a", "b").applyInArrow(task, "u long, v long")


def _large_links(large: DataFrame, sets: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """links, and those of the large groups; large: key, node, size, shingles."""
    whole = sets.where("minima is not null").join(nodes.select("node", "keys"), "node")
    rows = written(_blocked(large).join(whole, "node"), "groups")
    never = F.lit(False)

    def known(rows: DataFrame) -> DataFrame:
        return rows.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))

    links = links.union(written(_block_links(known(rows).withColumn("met", never), False), "links-within"))
    many = rows.where("blocks > 1")
    if not many.limit(1).count():
        return links
    named = written(known(many), "groups-named")
    ahead = named.groupBy("key", "component").agg(F.min("node").alias("node"), F.sum(F.size("set")).alias("own")).select("key", "node")
    sizes = ahead.join(named.select("key", "node", F.size("set").alias("own")), ["key", "node"]).groupBy("key").agg(F.count("*").alias("size"), F.sum("own").alias("shingles")).where("size > 1")
    chosen = ahead.join(sizes, "key").join(named.drop("size", "shingles", "blocks", "block"), ["key", "node"])
    chosen = written(_blocked(chosen).withColumn("met", never), "groups-ahead")
    links = links.union(written(_block_links(chosen, False).union(_block_links(chosen, True)), "links-ahead"))
    named = named.drop("component").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = named.groupBy("key").agg(F.count_distinct("component").alias("parts")).where("parts > 1").select("key")
    left = named.join(apart, "key", "left_semi").join(chosen.select("key", "node", F.lit(True).alias("met")), ["key", "node"], "left").withColumn("met", F.coalesce("met", never))
    return links.union(written(_block_links(left, True), "links-across"))


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """u, v: nodes whose fingerprints are equal or linked in the search of `near_dedup`; nodes: node, fp."""
    of = written(nodes.groupBy("fp").agg(F.min("node").alias("of")), "fingerprints")
    same = nodes.join(of, "fp").where("node <> of").select(*_pair("node", "of"))
    met = near_dedup.links(of.select("fp")).distinct()  # one link may come of several keys
    for end in ("u", "v"):
        met = met.join(of.select(F.col("fp").alias(end), F.col("of").alias(f"{end}_of")), end)
    return same.union(met.select(*_pair("u_of", "v_of")))


def joined(docs: DataFrame, marks: DataFrame, first: DataFrame) -> DataFrame:
    """node and component of every node that has a link."""
    nodes = written(marks.where("node <> 0").groupBy("node").agg(F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.first("n").alias("n")), "nodes")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = written(nodes.select("node", "n", F.explode("keys").alias("key")).repartition(tasks, "key").sortWithinPartitions("key", "node").mapInArrow(_meet, "u long, v long, key long, size long, shingles long"), "candidates")
    large = met.where("size > 0").select("key", F.col("u").alias("node"), "size", "shingles")
    simhash = written(_simhash_pairs(nodes.select("node", "fp")), "simhash")
    pairs = met.where("size = 0").select(*_pair("u", "v")).union(simhash).distinct()
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node"), F.lit(False).alias("large"))
    known = ends.union(large.select("node", F.lit(True))).groupBy("node").agg(F.max("large").alias("large"))
    sets = written(_sets(docs, first, known), "sets")
    links = written(_checked(pairs, sets), "copies")
    if large.limit(1).count():
        links = _large_links(large, sets, nodes, links)
    return components(links)


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that no earlier row is linked with."""
    marks = written(prints(docs), "prints")
    first = marks.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    named = first.join(joined(docs, marks, first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of, row, mine = fresh(docs, "of"), fresh(docs, "row"), fresh(docs, "mine")
    stay = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(of), F.col("first.row").alias(row))
    rows = docs.withColumn(mine, row_key(docs)).join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(mine) == F.col(row)), "left_semi")
    if marks.groupBy("doc_id", "row").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", mine])
    return rows.select(*(f"`{c}`" for c in docs.columns))
