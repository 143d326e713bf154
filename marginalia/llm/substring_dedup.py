"""Removal of passages that an earlier document has too: Rabin-Karp hashes of every 50-word window, counted in Spark.

1. Each task hashes every window of its texts (two rolling polynomials over independent word hashes, of 64 and 32 bits).
   Of the windows of a slice of texts that are alike, the one of the smallest doc_id asks; the others are known to be
   repeated. Requests are dealt by the upper bits of the hash, so that a part holds whole hashes; a row carries a
   slice's requests for one part, packed: the lower 56 bits of each hash (the upper ones are the part), its 32 check
   bits and the documents as steps.
2. Each part sorts its hashes and finds those that a smaller doc_id has too. Its answers, like those that were known
   before, are packed by a hash of the doc_id.
3. Texts and answers meet by that hash. A text's windows are hashed again, those answered are marked, and marked
   windows merge into maximal intervals of words, which are taken out.

Two windows count as equal if all 96 bits are: among n windows about n * n / 2**97 pairs are expected to meet by chance,
0.0006 of 10**13. A window repeated in very many documents is asked for once a slice, so no part holds a row for each of
its copies. Parts and buckets grow with the bytes of text (about `PART_BYTES` each; at most 2**17 parts, slices growing
so that a row still packs some windows), and so do the shuffle's partitions beyond those that the session sets. A part
of very many windows is gone through by ranges of the hash. Texts cross the shuffle once, compressed, and are inflated a
bounded piece at a time.

Nulls: a null text has no words and is kept null. A null doc_id counts as smaller than all others. Rows of one doc_id
are one document: they don't remove words of each other. An empty table gives no rows. Columns of the input other
than text are passed on, whatever their names; columns named n_words, n_removed or removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import wordspans as ws
from marginalia.llm.common import SLICE_BYTES, column, fresh, ints, slices, table

WINDOW = 50
#: Bytes of text for a part or bucket, and for a shuffle partition; windows that a part sorts at once.
PART_BYTES, TASK_BYTES, SORTED = 32 << 20, 128 << 20, 1 << 23
#: The polynomials' bases, and their inverses.
_BASES = [np.uint64(b) for b in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]
_UNBASES = [np.uint64(pow(int(b), -1, 2**64)) for b in _BASES]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(array: pa.Array, window: int = WINDOW, checked: bool = False) -> tuple:
    """The hash of every window, its document and its first word; and the words (buf, off, start, end, bounds). With
    checked, a hash of 32 bits independent of the first comes last."""
    buf, off = ws.bytes_of(array)
    start, end, doc = ws.spans(buf, off)
    bound = ws.per_document(doc, len(off) - 1)
    key, size = ws.keys(buf, start, end)
    n = len(start)
    count = np.maximum(np.diff(bound) - window + 1, 0)
    of = np.repeat(np.arange(len(count)), count)
    at = np.repeat(bound[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))

    def rolled(which: int) -> np.ndarray:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(ws.hashes(key, size, seed=1 + which) * _powers(_BASES[which], n), out=sums[1:], dtype=np.uint64)
        # sums over a window, brought to the same power wherever it stands, then mixed so that all bits are even
        return ws.mixed((sums[at + window] - sums[at]) * _powers(_UNBASES[which], n + 1)[at])

    out = rolled(0), of, at, (buf, off, start, end, bound)
    return (*out, (rolled(1) >> np.uint64(32)).astype(np.uint32)) if checked else out


def _runs(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal windows together (as they came), and whether each in it is the first of its kind."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if (~new[1:] & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, h))
        new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
    return order, new


def _packed(h: np.ndarray, check: np.ndarray, doc_id: np.ndarray) -> tuple[bytes, int, int, bytes]:
    """56 bits of each hash and its check; the first doc_id, the width of the steps and the steps. Rows are sorted by doc_id."""
    step = np.diff(doc_id.astype(np.uint64), prepend=doc_id[:1].astype(np.uint64))
    most = int(step.max())
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    both = np.concatenate([h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7], check.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
    return both.tobytes(), int(doc_id[0]), width, step.astype(f"<u{width}").tobytes()


def _unpacked(both: bytes, first: int, width: int, step: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(both, np.uint8).reshape(-1, 11)
    low = np.zeros((len(raw), 8), np.uint8)
    low[:, :7] = raw[:, :7]
    steps = np.frombuffer(step, f"<u{width}").astype(np.uint64)
    ids = (np.cumsum(steps, dtype=np.uint64) + np.array([first]).astype(np.uint64)).astype(np.int64)
    return low.view("<u8").reshape(-1), np.ascontiguousarray(raw[:, 7:]).view("<u4").reshape(-1), ids


_PACK = "part int, known boolean, high int, hashes binary, first long, width int, steps binary"
_NAMES = ["part", "known", "high", "hashes", "first", "width", "steps"]
_TYPES = [pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]


def _rows(got: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [[]] * len(_TYPES), _TYPES)], names=_NAMES)


def _by(group: np.ndarray, h: np.ndarray, check: np.ndarray, doc_id: np.ndarray, known: bool, answer: bool = False) -> Iterator[tuple]:
    """Packed rows for each group; answers also by the upper bits of the hash, which a row states once."""
    if not len(group):
        return
    order = np.argsort(group, kind="stable")
    group = group[order]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        i = order[a:b]
        yield (int(group[a] & ((1 << 31) - 1)) if answer else int(group[a]), known, int(group[a] >> 31) if answer else -1, *_packed(h[i], check[i], doc_id[i]))


def _mix_ids(doc_id: np.ndarray, buckets: int) -> np.ndarray:
    return (ws.mixed(doc_id.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def requests(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """Packed rows: what is asked (part: upper bits of the hash), and what is known already (dealt alike)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=max(SLICE_BYTES, 100 << bits)):
            ids = ints(column(batch, "doc_id"))
            if (np.diff(ids) < 0).any():
                order = np.argsort(ids, kind="stable")
                batch, ids = batch.take(pa.array(order)), ids[order]
            h, of, _, _, check = window_hashes(column(batch, "text"), window, checked=True)
            if not len(h):
                continue
            order, new = _runs(h, check)
            leader = np.empty(len(h), np.int64)
            leader[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            doc_id = ids[of]
            part = (h >> np.uint64(64 - bits)).astype(np.int64)
            ask, known = np.flatnonzero(leader == np.arange(len(h))), np.flatnonzero(doc_id > doc_id[leader])
            out = [row for rows, is_known in ((ask, False), (known, True)) for row in _by(part[rows], h[rows], check[rows], doc_id[rows], is_known)]
            for at in range(0, len(out), 4096):
                yield _rows(out[at : at + 4096])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _PACK)


def answers(asked: DataFrame, bits: int, buckets: int, at_once: int = SORTED) -> DataFrame:
    """Packed rows by bucket (part: hash of doc_id) of the windows to be taken out; high: upper bits of their hashes."""

    def late(packs: list[tuple], low: int, high: int) -> list[np.ndarray]:
        """The asked windows with hashes from low to high that a smaller doc_id has too."""
        parts = []
        for pack in packs:
            got = _unpacked(*pack)
            inside = slice(None) if high - low == 1 << 56 else (got[0] >= np.uint64(low)) & (got[0] < np.uint64(high))
            parts.append([x[inside] for x in got])
        h, check, doc_id = (np.concatenate(x) for x in zip(*parts))
        order, new = _runs(h, check)
        least = np.empty(len(h), np.int64)
        if len(h):
            starts = np.flatnonzero(new)
            least[order] = np.repeat(np.minimum.reduceat(doc_id[order], starts), np.diff(np.append(starts, len(h))))
        keep = doc_id > least
        return [h[keep], check[keep], doc_id[keep]]

    def part(key: tuple, rows: pa.Table) -> pa.Table:
        number, packs = key[0].as_py(), {False: [], True: []}
        for known, *r in zip(*(rows[n].to_pylist() for n in ("known", "hashes", "first", "width", "steps"))):
            packs[known].append(r)
        ranges = 1 + sum(len(r[0]) // 11 for r in packs[False]) // at_once
        edge = [(i << 56) // ranges for i in range(ranges + 1)]
        found = [late(packs[False], a, b) for a, b in zip(edge, edge[1:])] if packs[False] else []
        found += [_unpacked(*r) for r in packs[True]]
        h, check, doc_id = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(doc_id, kind="stable")
        h, check, doc_id = h[order], check[order], doc_id[order]
        group = _mix_ids(doc_id, buckets) | np.int64(number) << 31
        return pa.Table.from_batches([_rows([*_by(group, h, check, doc_id, True, answer=True)])])

    return asked.groupBy("part").applyInArrow(part, _PACK)


def intervals(marked: np.ndarray, at: np.ndarray, window: int, words: int) -> np.ndarray:
    """Whether each word lies in a marked window; at: the windows' first words."""
    step = np.zeros(words + 1, np.int64)
    np.add.at(step, at[marked], 1)
    np.add.at(step, at[marked] + window, -1)
    return np.cumsum(step[:-1]) > 0


def _marked(h: np.ndarray, check: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which windows of a document are among those found."""
    fh, fc = (np.concatenate(x) for x in zip(*found))
    order, new = _runs(fh, fc)
    fh, fc = fh[order][new], fc[order][new]
    at = np.minimum(np.searchsorted(fh, h), len(fh) - 1)
    hit = fh[at] == h
    same = hit & (fc[at] == check)
    for i in np.flatnonzero(hit & ~same):  # hashes alike by chance: the checks decide
        j = at[i]
        while j < len(fh) and fh[j] == h[i]:
            same[i] |= fc[j] == check[i]
            j += 1
    return same


def removed(docs: DataFrame, window: int = WINDOW, all_joined: bool = False) -> DataFrame:
    """The rows of docs with the kept text and n_words, n_removed, removed (maximal intervals of words: start, end).

    A text that loses words is its kept words joined by one space; other texts stay as they are, unless all_joined."""
    spark = docs.sparkSession
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c not in ("n_words", "n_removed", "removed")))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(17, max(8, (total // PART_BYTES).bit_length()))
    buckets, tasks = max(1 << bits, total // PART_BYTES), total // TASK_BYTES

    def dealt(rows: DataFrame, key: str) -> DataFrame:
        """More partitions than the session sets, where the texts are that large."""
        return rows.repartition(tasks, key) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows

    answer = answers(dealt(requests(docs, window, bits), "part"), bits, buckets)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_words long, n_removed long, removed array<struct<start:long,end:long>>").fields])
    packed, bucket = fresh(docs, "packed"), fresh(docs, "bucket")
    packed_schema = T.StructType([T.StructField(packed, T.BinaryType()) if f.name == "text" else f for f in docs.schema.fields] + [T.StructField(bucket, T.IntegerType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            cols = [pa.array([None if t is None else squeeze(t) for t in column(batch, "text").cast(pa.binary()).to_pylist()], pa.binary()) if n == "text" else column(batch, n) for n in batch.schema.names]
            number = _mix_ids(ints(column(batch, "doc_id")), buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(number)], names=packed_schema.names)

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        hit: dict[int, list] = {}
        top = np.uint64(((1 << bits) - 1) << (64 - bits))
        for high, *r in zip(*(right[n].to_pylist() for n in ("high", "hashes", "first", "width", "steps"))):
            h, check, doc_id = _unpacked(*r)
            h = (h & ~top) | np.uint64(high) << np.uint64(64 - bits)
            cut = np.flatnonzero(np.concatenate([[True], doc_id[1:] != doc_id[:-1], [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                hit.setdefault(int(doc_id[a]), []).append((h[a:b], check[a:b]))
        unpack = zstandard.ZstdDecompressor().decompress
        squeezed = left[packed].to_pylist()
        ids = ints(left["doc_id"].combine_chunks() if left.num_rows else left["doc_id"])
        kept, words, gone, spans = [], [], [], []
        sizes, at = np.cumsum([0 if t is None else zstandard.frame_content_size(t) for t in squeezed]), 0
        while at < len(squeezed):  # a bounded piece at a time
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            raw = [None if t is None else unpack(t) for t in squeezed[at:end]]
            h, of, first, (buf, _, start, stop, bound), check = window_hashes(pa.array(raw, pa.large_binary()), window, checked=True)
            lies = np.searchsorted(of, np.arange(end - at + 1))
            out = np.zeros(len(start), bool)
            for i in range(end - at):
                found = hit.get(int(ids[at + i]))
                if found:
                    mine = slice(lies[i], lies[i + 1])
                    out[bound[i] : bound[i + 1]] = intervals(_marked(h[mine], check[mine], found), first[mine] - bound[i], window, int(bound[i + 1] - bound[i]))
            all_bytes = buf.tobytes()
            for i, text in enumerate(raw):
                a, b = int(bound[i]), int(bound[i + 1])
                off = out[a:b]
                n = int(off.sum())
                words.append(b - a)
                gone.append(n)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], off.view(np.int8), [0]]))) if n else np.zeros(0, np.int64)
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                if text is not None and (n or all_joined):
                    text = b" ".join([all_bytes[x:y] for x, y in zip(start[a:b][~off].tolist(), stop[a:b][~off].tolist())]) if n else b" ".join(text.split())
                kept.append(text)
            at = end
        new = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        return pa.table({n: new[n] if n in new else left[n] for n in schema.names})

    texts = dealt(docs.mapInArrow(pack, packed_schema), bucket)
    return texts.groupBy(bucket).cogroup(dealt(answer, "part").groupBy("part")).applyInArrow(meet, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = removed(table(spark, sf_dir, "documents").select("doc_id", "text"), all_joined=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with words as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
first as (select h, min(doc_id) as d from windows group by h),
marked as (select distinct doc_id, unnest(range(i, i + 50)) as p from windows join first using (h) where d < doc_id),
gone as (select doc_id, list(p) as ps, count(*) as n from marked group by doc_id)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(array_to_string(case when n is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda p: not list_contains(ps, p)), lambda p: w[p]) end, ' ')) as kept_sha256
from words left join gone using (doc_id)
"""
