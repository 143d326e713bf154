"""Ranked lexical search with exact top-k results by MaxScore with bounds for pairs of terms.

Index. The texts are read once and become segments of some MB: the rows' ids and numbers of terms, and for each term that
is asked for its documents and occurrences. From all segments come the corpus' counts (documents, terms, and in how many
documents each term is). With these a second step stores impacts, that is what a term adds to a document's score (without
the term's weight, which is one number for all), and the intersection lists: for each pair of terms that are neighbours in
some item's order (by rising weight, then by term) the documents that hold both, and with each list the highest joint
impact. It is often far below the sum of both terms' own maxima, since few documents are the best for both.

Search. A task goes through its segments with the k best scores of each item so far; the last of them is the threshold.
The bound of an item's first i terms is the least of two combinations: that of i-1 terms and the i-th term's maximum, or
that of i-2 terms and the bound of the pair (the highest of its joint maximum and of either term's own). Terms whose bound
is below the threshold only complete documents that others name. Of the pairs after them, as far as documents without both
terms of a pair stay below, only the intersection lists name documents, not the terms' own. A document is given up as soon
as its score so far and the bound of the terms that are left are below. Equal scores are never given up, so ties by doc_id
come out right.

Each task gives at most k rows an item; the best k are chosen among groups of tasks, then among those. Items are taken in
blocks of `block_items`, a pass over the texts each: their terms and counts are what is sent to the tasks, so its size is
bounded by a block.

Nulls: a null text has no terms, in documents and items. A null doc_id is a document like any other, last among equals. Rows
count each, repeated ones too; rows of one item_id are one item. Items without a match and empty tables give no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm import wordspans as ws
from marginalia.llm.common import column, ints, offsets, slices, table, written

TOP, SEGMENT_BYTES, SEGMENT_ROWS, BLOCK_ITEMS = 50, 8 << 20, 1 << 16, 1000
#: Bytes that no term has: ASCII but for digits and letters.
CUT = np.zeros(256, bool)
CUT[:128] = [not chr(b).isalnum() for b in range(128)]


def term_spans(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with A-Z lowered, and start, end and document number of each term."""
    buf, off = ws.bytes_of(array)
    n = int(off[-1])
    buf = buf.copy()
    buf[:n][(buf[:n] >= 65) & (buf[:n] <= 90)] += 32
    return buf, *ws.spans(buf, off, CUT)


def terms_of(text: str | None) -> list[bytes]:
    """The distinct terms of one text, sorted."""
    buf, start, end, _ = term_spans(pa.array([text], pa.string()))
    raw = buf.tobytes()
    return sorted({raw[a:b] for a, b in zip(start.tolist(), end.tolist())})


class Asked:
    """The terms that are asked for, found in texts by their bytes."""

    def __init__(self, terms: list[bytes]):
        size = np.array([len(t) for t in terms], np.int64)
        at = offsets(size)
        buf = np.concatenate([np.frombuffer(b"".join(terms), np.uint8), np.zeros(ws.KEY_BYTES, np.uint8)])
        self.key, self.size = ws.keys(buf, at[:-1], at[1:])
        h = ws.hashes(self.key, self.size)
        self.order = np.argsort(h, kind="stable")
        self.hash = h[self.order]

    def find(self, key: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 where it isn't asked for."""
        h = ws.hashes(key, size)
        out = np.full(len(size), -1)
        left, at = np.arange(len(size)), np.searchsorted(self.hash, h)
        while len(left):  # terms of one hash follow each other
            left = left[at[left] < len(self.hash)]
            left = left[self.hash[at[left]] == h[left]]
            term = self.order[at[left]]
            same = self.size[term] == size[left]
            for mine, theirs in zip(self.key, key):
                same &= mine[term] == theirs[left]
            out[left[same]] = term[same]
            left = left[~same]
            at[left] += 1
        return out


def _segment(number: int, parts: list[tuple]) -> pa.RecordBatch:
    """The row of a segment from its slices: postings by term, then by document."""
    ids, n, term, doc, tf = zip(*parts)
    shift = offsets(np.array([len(x) for x in n], np.int64))[:-1]
    doc, term, tf = np.concatenate([d + s for d, s in zip(doc, shift)]), np.concatenate(term), np.concatenate(tf)
    order = np.argsort(term, kind="stable")
    own, df = np.unique(term, return_counts=True)
    row = {
        "segment": [number], "ids": [[i for x in ids for i in x]], "n": [np.concatenate(n).astype("<u4").tobytes()], "holding": [int((np.concatenate(n) > 0).sum())], "total": [int(np.concatenate(n).sum())],
        "term": [own.tolist()], "df": [df.tolist()], "doc": [doc[order].astype("<u2").tobytes()], "tf": [tf[order].astype("<u4").tobytes()],
    }
    return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in _SEGMENT], schema=_SEGMENT)


_SEGMENT = pa.schema([("segment", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.binary()), ("holding", pa.int64()), ("total", pa.int64()), ("term", pa.list_(pa.int32())), ("df", pa.list_(pa.int32())), ("doc", pa.binary()), ("tf", pa.binary())])


def segments(docs: DataFrame, terms: list[bytes], segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """A row for each segment: ids and numbers of terms of its documents, and the postings of the asked terms."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, number, held, rows, parts = Asked(terms), TaskContext.get().partitionId() << 32, 0, 0, []
        for whole in slices(batches):
            for at in range(0, whole.num_rows, SEGMENT_ROWS):
                batch = whole.slice(at, SEGMENT_ROWS)
                if parts and (held >= segment_bytes or rows + batch.num_rows > SEGMENT_ROWS):
                    yield _segment(number, parts)
                    number, held, rows, parts = number + 1, 0, 0, []
                buf, start, end, doc = term_spans(column(batch, "text"))
                key, size = ws.keys(buf, start, end)
                first, word = ws.distinct(key, size)
                term = asked.find([k[first] for k in key], size[first])[word]
                has = term >= 0
                pair, tf = np.unique(term[has] * batch.num_rows + doc[has], return_counts=True)
                parts.append((column(batch, "doc_id").to_pylist(), np.bincount(doc, minlength=batch.num_rows), pair // batch.num_rows, pair % batch.num_rows, tf))
                rows, held = rows + batch.num_rows, held + (pc.sum(pc.binary_length(column(batch, "text"))).as_py() or 0)
        if parts:
            yield _segment(number, parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "segment long, ids array<long>, n binary, holding long, total long, term array<int>, df array<int>, doc binary, tf binary")


def weight(holding: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * holding + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, holding: int, total: int) -> np.ndarray:
    """What a term of weight 1 adds to documents with so many occurrences of it and n terms in all; below 10^6."""
    m = 100 - 50 + (50 * n * holding) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


_INDEX = "segment long, ids array<long>, term binary, bound binary, doc binary, impact binary, pair binary, pair_bound binary, pair_doc binary, joint binary"


def index(parts: DataFrame, weights: np.ndarray, pairs: np.ndarray, holding: int, total: int) -> DataFrame:
    """The segments with impacts, and the intersection lists of pairs (two columns of term numbers, sorted) with their
    highest joint impact."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                term, bound = np.array(row["term"], np.int64), offsets(np.array(row["df"], np.int64))
                doc, tf, n = (np.frombuffer(row[c], d).astype(np.int64) for c, d in (("doc", "<u2"), ("tf", "<u4"), ("n", "<u4")))
                impact = impacts(tf, n[doc], holding, total)
                at = np.full(len(weights), -1)
                at[term] = np.arange(len(term))
                mine = np.flatnonzero((at[pairs[:, 0]] >= 0) & (at[pairs[:, 1]] >= 0))
                lists, joint, kept, left, of_left = [], [], [], -1, np.zeros(len(n), np.int64)
                for p, (a, b) in zip(mine.tolist(), at[pairs[mine]].tolist()):
                    if a != left:  # pairs of one term follow each other
                        of_left[doc[bound[left] : bound[left + 1]] if left >= 0 else []] = 0
                        of_left[doc[bound[a] : bound[a + 1]]] = weights[term[a]] * impact[bound[a] : bound[a + 1]] + 1
                        left = a
                    also = of_left[doc[bound[b] : bound[b + 1]]]
                    both = also > 0
                    if both.any():
                        kept.append(p)
                        lists.append(doc[bound[b] : bound[b + 1]][both])
                        joint.append(int((also[both] - 1 + weights[term[b]] * impact[bound[b] : bound[b + 1]][both]).max()))
                columns = [term.astype("<i4"), bound.astype("<i8"), doc.astype("<u2"), impact.astype("<u4"), np.array(kept, "<i4"), offsets(np.array([len(x) for x in lists], np.int64)).astype("<i8"), np.concatenate(lists or [np.zeros(0, np.int64)]).astype("<u2"), np.array(joint, "<i8")]
                yield pa.RecordBatch.from_arrays([pa.array([row["segment"]], pa.int64()), pa.array([row["ids"]], pa.list_(pa.int64())), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=[f.split()[0] for f in _INDEX.split(", ")])

    return parts.select("segment", "ids", "n", "term", "df", "doc", "tf").mapInArrow(task, _INDEX)


class Best:
    """The k highest (score, document) of one item; of equal scores the smaller id, null last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        score, ids, none = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.none, none])
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.id, self.none = score[order], ids[order], none[order]


class Segment:
    """One row of the index, opened."""

    def __init__(self, row: dict, weights: np.ndarray, pairs: int):
        read = lambda c, d: np.frombuffer(row[c], d)
        self.rows, self.weights = len(row["ids"]), weights
        self.none = np.array([i is None for i in row["ids"]], bool)
        self.ids = np.array([i or 0 for i in row["ids"]], np.int64)
        term, self.bound, self.doc, self.impact = read("term", "<i4"), read("bound", "<i8"), read("doc", "<u2"), read("impact", "<u4")
        self.at, self.most = np.full(len(weights), -1), np.zeros(len(weights), np.int64)
        self.at[term] = np.arange(len(term))
        if len(term):
            self.most[term] = weights[term] * np.maximum.reduceat(self.impact, self.bound[:-1]).astype(np.int64)
        pair, self.pair_bound, self.pair_doc = read("pair", "<i4"), read("pair_bound", "<i8"), read("pair_doc", "<u2")
        self.pair_at, self.joint = np.full(pairs, -1), np.zeros(pairs, np.int64)
        self.pair_at[pair], self.joint[pair] = np.arange(len(pair)), read("joint", "<i8")

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """A term's documents and what it adds to them."""
        i = self.at[term]
        part = slice(self.bound[i], self.bound[i + 1]) if i >= 0 else slice(0)
        return self.doc[part].astype(np.int64), self.weights[term] * self.impact[part].astype(np.int64)

    def holding_both(self, pair: int) -> np.ndarray:
        i = self.pair_at[pair]
        return self.pair_doc[self.pair_bound[i] : self.pair_bound[i + 1]] if i >= 0 else self.pair_doc[:0]

    def bounds(self, terms: np.ndarray, pairs: np.ndarray) -> list[int]:
        """For i from 0, the most that the first i terms add to any document; pairs: of each term and the one after it."""
        most, joint = self.most[terms].tolist(), self.joint[pairs].tolist()
        out = [0]
        for i, x in enumerate(most):
            out.append(out[-1] + x)
            if i:
                out[-1] = min(out[-1], out[-3] + max(joint[i - 1], x, most[i - 1]))
        return out

    def search(self, terms: np.ndarray, pairs: np.ndarray, best: Best) -> None:
        """Adds the documents of this segment that are among the best of the item with these terms."""
        bounds, least = self.bounds(terms, pairs), best.threshold
        if bounds[-1] < least:
            return
        split = next(i for i in range(len(terms), -1, -1) if bounds[i] < least)  # bounds[0] is 0
        apart, listed = bounds[split], []  # the most that a document adds which no list names
        while split + 2 <= len(terms) and apart + (one := max(self.most[terms[split]], self.most[terms[split + 1]])) < least:
            listed.append(self.holding_both(pairs[split]))
            apart, split = apart + one, split + 2
        score = np.zeros(self.rows, np.int64)
        named = np.zeros(self.rows, bool)
        for t in terms[split:].tolist():
            d, x = self.postings(t)
            score[d] += x
            named[d] = True
        for d in listed:
            named[d] = True
        doc = np.flatnonzero(named)
        score = score[doc]
        for i in range(split, 0, -1):
            open_ = score + bounds[i] >= least
            if not open_.all():
                doc, score = doc[open_], score[open_]
            if not len(doc):
                return
            d, x = self.postings(int(terms[i - 1]))
            if len(d):
                at = np.minimum(np.searchsorted(d, doc), len(d) - 1)
                score = score + np.where(d[at] == doc, x[at], 0)
        keep = score >= least
        best.add(score[keep], self.ids[doc[keep]], self.none[doc[keep]])


def found(indexed: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, pairs: int, k: int = TOP) -> DataFrame:
    """item (its number), task, doc_id and score: each task's k best of each item."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0], weights, pairs)
                for (own, neighbours), b in zip(items, best):
                    segment.search(own, neighbours, b)
        size = [len(b.score) for b in best]
        ids = pa.array(np.concatenate([b.id for b in best]), mask=np.concatenate([b.none for b in best]))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(items)), size), pa.int32()), pa.array(np.full(sum(size), TaskContext.get().partitionId()), pa.int32()), ids, pa.array(np.concatenate([b.score for b in best]))], names=["item", "task", "doc_id", "score"])

    return indexed.drop("segment").mapInArrow(task, "item int, task int, doc_id long, score long")


def _ranked(docs: DataFrame, block: dict[int | None, set[bytes]], k: int, segment_bytes: int) -> DataFrame:
    """The results of one block of items."""
    spark = docs.sparkSession
    terms = sorted(set().union(*block.values()))
    number = {t: i for i, t in enumerate(terms)}
    parts = written(segments(docs, terms, segment_bytes), "segments")
    holding, total = parts.agg(F.coalesce(F.sum("holding"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    counted = parts.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}  # at most one row for each term of the block
    weights = np.array([weight(holding, df[i]) if i in df else 0 for i in range(len(terms))], np.int64)
    orders = {item: sorted((number[t] for t in own if number[t] in df), key=lambda i: (weights[i], i)) for item, own in block.items()}
    pairs = sorted({p for own in orders.values() for p in zip(own, own[1:])})
    place = {p: i for i, p in enumerate(pairs)}
    items = [(np.array(own, np.int64), np.array([place[p] for p in zip(own, own[1:])], np.int64)) for own in orders.values()]
    indexed = written(index(parts, weights, np.array(pairs, np.int64).reshape(-1, 2), holding, total), "impacts")
    hits = written(found(indexed, items, weights, len(pairs), k), "hits")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = hits.withColumn("place", F.row_number().over(Window.partitionBy("item", F.expr("task div 512")).orderBy(*order))).where(F.col("place") <= k)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(orders)), "item int, item_id long")
    return top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_items: int = BLOCK_ITEMS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0."""
    out, block = None, {}
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id").toLocalIterator()
    for row in rows:
        if row["item_id"] not in block and len(block) == block_items:
            part = _ranked(docs, block, k, segment_bytes)
            out, block = part if out is None else out.unionByName(part), {}
        block.setdefault(row["item_id"], set()).update(terms_of(row["text"]))
    if block:
        part = _ranked(docs, block, k, segment_bytes)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""with d as (select row_number() over () as place, doc_id, {_TERMS} as terms from documents where text is not null),
    g as (select count(*) as nd, sum(len(terms))::bigint as l from d where len(terms) > 0),
    q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
    tf as (select place, term, count(*) as tf from (select place, unnest(terms) as term from d) semi join q using (term) group by all),
    w as (select term, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tf group by term), g),
    m as (select place, doc_id, 100 - 50 + ((50 * len(terms) * nd) // l) as m from d, g where len(terms) > 0),
    s as (select item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from q join tf using (term) join w using (term) join m using (place) group by all),
    r as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0)
    select item_id, rank::int as rank, doc_id, score from r where rank <= {TOP}"""
