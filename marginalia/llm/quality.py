"""Quality rules, and a check of each document's distribution against its language.

Base rules look at the words of the document itself: their number, characters and symbols, lines that repeat, words in
repeated 3-word windows.

The check compares two histograms with references by Jensen-Shannon distance (base 2, 0 to 1): classes of characters
(kinds of ASCII; beyond it, the first byte and the upper bits of the last one, so that scripts of any kind have many
classes), and common words (the rest of the words in one bin). References are sums over all documents of a language that
pass the base rules; the common words are the `common` ones that most documents of a language have, counted over all of
its documents and words of any length. A document is compared with the reference of every language and judged by the
nearest one.

A short document has a rough histogram: its distances are larger by about a slope over the root of its number of
words. What is left beyond that is held against a limit for each kind of distance; over either, the document is dropped.
Slopes and limits are fitted on all labelled documents: slopes by least squares over the good ones, limits where the share of bad documents dropped exceeds that of good ones dropped by most, of those that keep at
least `keep_good` of the good. Without labels of both kinds `LIMITS` hold. Documents of under `guard_words` words,
more than the base rules ask for, are not judged by distance.

Three passes over the texts, no shuffle of texts: counts of words and sums per task, then some rows per language to the
driver; the third writes each document's counts and distances (narrow rows) to the shared folder. Limits are fitted on these by
sums and by running counts over the sorted distances, in tasks; the verdicts are made from them too.

Nulls: a null text has no words and fails the base rules. A null doc_id is kept. Documents without a language are in no
reference. Where there is no reference (an empty table, say), the base rules alone decide. Repeated rows give equal
results. Columns other than doc_id, text and lang are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm import wordspans as ws
from marginalia.llm.common import column, slices, table, written
from marginalia.operators import scan

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
#: Classes of ASCII characters; those beyond it follow, eight for each first byte.
ASCII = ("vowel", "consonant", "upper", "digit", "blank", "line", "stop", "mark", "symbol", "control")
CLASSES = len(ASCII) + 8 * (0xF8 - 0xC0)


def _classes() -> np.ndarray:
    """The class of each first byte of a character; -1 for bytes that go on one."""
    out = np.full(256, 9, np.int16)
    for chars, k in ((b"aeiou", 0), (b"bcdfghjklmnpqrstvwxyz", 1), (bytes(range(65, 91)), 2), (b"0123456789", 3), (b" \t", 4), (b"\n", 5), (b".,;:", 6), (b"!?'\"()-", 7), (b"#*$%&|<>@[]{}=+/\\^_`~", 8)):
        out[list(chars)] = k
    out[128:192] = -1
    out[192:248] = len(ASCII) + 8 * np.arange(0xF8 - 0xC0)
    return out


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sums(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def repeated_words(number: np.ndarray, doc: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Words of each document that lie in a 3-word window found twice or more in it; number: equal for equal words."""
    n, docs = len(number), len(bound) - 1
    out = np.zeros(docs, np.int64)
    if n < 3:
        return out
    first = np.flatnonzero(doc[:-2] == doc[2:])
    if not len(first):
        return out
    top = int(number.max()) + 1
    pair = number[first].astype(np.int64) * top + number[first + 1]
    if top >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * top + number[first + 2]
    order = np.lexsort((window, doc[first]))
    w, d = window[order], doc[first][order]
    same = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = first[order[twice]]
    covered = np.zeros(n, bool)
    for step in range(3):
        covered[at + step] = True
    return np.bincount(doc[covered], minlength=docs)


def measured(array: pa.Array) -> tuple[dict[str, np.ndarray], tuple]:
    """The base counts of each text; and the words (lower-case bytes, start, end, doc, bounds, first, number, off)."""
    buf, off = ws.bytes_of(array)
    n, docs = int(off[-1]), len(off) - 1
    start, end, doc = ws.spans(buf, off)
    bound = ws.per_document(doc, docs)
    b = buf[:n]
    begins = (b & 0xC0) != 0x80
    first, number = ws.distinct(*ws.keys(buf, start, end))
    ls, le, ld = ws.spans(buf, off, _LINE)
    # a line with a word: some byte of it isn't white
    full = np.zeros(n + 1, np.int64)
    np.cumsum(~ws.WHITE[b], out=full[1:])
    has = full[le] > full[ls]
    ls, le, ld = ls[has], le[has], ld[has]
    line = ws.distinct(*ws.keys(buf, ls, le))[1]
    lines = np.bincount(ld, minlength=docs)
    kinds = np.bincount(np.unique(ld * np.int64(max(1, len(line))) + line) // max(1, len(line)), minlength=docs) if len(line) else lines
    counts = {
        "n_words": np.diff(bound).astype(np.int64),
        "word_chars": _sums(begins & ~ws.WHITE[b], off),
        "n_symbols": _sums(_SYMBOL[b], off),
        "n_dup_lines": lines - kinds,
        "n_repeat_words": repeated_words(number, doc, bound),
    }
    return counts, (buf, start, end, doc, bound, first, number, off)


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def histograms(words: tuple, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of the known words (the last column: all others), a row for each document."""
    buf, start, end, doc, bound, first, number, off = words
    docs, n = len(off) - 1, int(off[-1])
    kind = _CLASS[buf[:n]]
    first_of = np.flatnonzero(kind >= len(ASCII))
    last = first_of + 1 + (buf[first_of] >= 0xE0) + (buf[first_of] >= 0xF0)
    kind[first_of] += ((buf[last] >> 3) & 7).astype(np.int16)
    char_doc = np.repeat(np.arange(docs), np.diff(off))
    chars = np.bincount((char_doc * CLASSES + kind)[kind >= 0], minlength=docs * CLASSES).reshape(docs, -1)
    raw = _LOWER[buf].tobytes()
    other = len(known)
    place = np.array([known.get(raw[a:b], other) for a, b in zip(start[first].tolist(), end[first].tolist())] or [0], np.int64)
    found = np.bincount(doc * (other + 1) + place[number], minlength=docs * (other + 1)).reshape(docs, -1) if len(doc) else np.zeros((docs, other + 1), np.int64)
    return chars, found


def _shares(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p (shares) from q: the root of the divergence in bits."""
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)

    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def common_words(docs: DataFrame, common: int = 100, most_held: int = 200_000) -> dict[str, list[bytes]]:
    """The lower-case words that most of each language's documents have; a task holds about `most_held` counts at once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])
            seen.clear()
            return out

        for batch in slices(batches):
            buf, off = ws.bytes_of(column(batch, "text"))
            start, end, doc = ws.spans(buf, off)
            buf = _LOWER[buf]
            first, number = ws.distinct(*ws.keys(buf, start, end))
            if not len(first):
                continue
            langs = column(batch, "lang").to_pylist()
            names = list(dict.fromkeys(langs))
            of = np.array([names.index(x) for x in langs], np.int64)
            there = np.unique(doc * np.int64(len(first)) + number)  # a word once a document
            cell, n = np.unique(of[there // len(first)] * np.int64(len(first)) + there % len(first), return_counts=True)
            raw = buf.tobytes()
            for c, k in zip(cell.tolist(), n.tolist()):
                i = first[c % len(first)]
                seen[names[c // len(first)], raw[start[i] : end[i]]] += k
            if len(seen) > most_held:
                yield rows()
        yield rows()

    sums = docs.where("lang is not null").select("text", "lang").mapInArrow(task, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= common)
    out: dict[str, list[bytes]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(bytes(r["word"]))
    return out


def references(docs: DataFrame, words: dict[str, list[bytes]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Shares of character classes and of all languages' common words in each language, over all its passing documents."""
    known = {w: i for i, w in enumerate(dict.fromkeys(w for ws_ in words.values() for w in ws_))}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}
        for batch in slices(batches):
            counts, found = measured(column(batch, "text"))
            hist = histograms(found, known)
            good, langs = ~failed(counts), np.array(column(batch, "lang").to_pylist(), object)
            for lang in {x for x in langs if x is not None}:
                rows = good & (langs == lang)
                new = [h[rows].sum(axis=0) for h in hist]
                total[lang] = [a + b for a, b in zip(total[lang], new)] if lang in total else new
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t[0] for t in total.values()], pa.list_(pa.int64())), pa.array([t[1] for t in total.values()], pa.list_(pa.int64()))], names=["lang", "chars", "words"])

    parts = docs.where("lang is not null").select("text", "lang").mapInArrow(task, "lang string, chars array<long>, words array<long>")
    cells = parts.select("lang", F.posexplode(F.concat("chars", "words")).alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("cells"))
    out = {}
    for r in sorted(cells.collect(), key=lambda r: r["lang"]):
        n = np.array([c["n"] for c in r["cells"]], np.float64)
        if n[: CLASSES].sum():
            out[r["lang"]] = (_shares(n[: CLASSES]), _shares(n[CLASSES :]))
    return out


class Limits(NamedTuple):
    """A slope and a limit for each kind of distance."""

    class_slope: float
    class_limit: float
    word_slope: float
    word_limit: float


#: What the given tables lead to; used where there are no labels.
LIMITS = Limits(0.3, 0.2, 1.2, 0.3)


class References(NamedTuple):
    """The known words and each language's shares of character classes and words."""

    words: dict[str, list[bytes]]
    shares: dict[str, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, docs: DataFrame, words: dict[str, list[bytes]] | None = None) -> References:
        words = common_words(docs) if words is None else words
        return cls(words, references(docs, words) if words else {})

    def known(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(dict.fromkeys(w for listed in self.words.values() for w in listed))}

    def distances(self, found: tuple, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest language (its place), class distance and word distance of each measured document."""
        chars, seen = histograms(found, known)
        best, dc, dw = (np.zeros(len(chars), t) for t in (np.int64, float, float))
        for at in range(0, len(chars), 500):  # shares of many documents at once would take much room
            rows = slice(at, at + 500)
            c, w = _shares(chars[rows]), _shares(seen[rows])
            both = np.stack([np.stack([distance(c, a), distance(w, b)]) for a, b in self.shares.values()])
            best[rows] = np.argmin(both.sum(axis=1), axis=0)
            dc[rows], dw[rows] = both[best[rows], :, np.arange(both.shape[2])].T
        return best, dc, dw


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, nearest string, class_distance double, word_distance double"


def measures(docs: DataFrame, refs: References) -> DataFrame:
    """The base counts and the nearest language with both distances of each row: all that a verdict needs, and no text."""
    known, names = refs.known(), list(refs.shares)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, found = measured(column(batch, "text"))
            if names:
                best, dc, dw = refs.distances(found, known)
                told = [pa.array([names[i] for i in best], pa.string()), pa.array(dc), pa.array(dw)]
            else:
                told = [pa.nulls(batch.num_rows).cast(t) for t in (pa.string(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c.astype(np.int64)) for c in counts.values()), pa.array(failed(counts)), *told], names=["doc_id", *counts, "base_failed", "nearest", "class_distance", "word_distance"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _OUT)


def _left(distance: str, slope: float) -> Column:
    """What a document's length leaves of its distance."""
    return F.col(distance) - F.lit(slope) / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))


def verdicts(rows: DataFrame, limits: Limits, guard_words: int = 75) -> DataFrame:
    """rows of measures with `kept`."""
    beyond = (_left("class_distance", limits.class_slope) > limits.class_limit) | (_left("word_distance", limits.word_slope) > limits.word_limit)
    far = F.coalesce((F.col("n_words") >= guard_words) & beyond, F.lit(False))
    names = rows.columns
    at = names.index("base_failed") + 1
    return rows.select(*names[:at], (~F.col("base_failed") & ~far).alias("kept"), *names[at:])


def judged(docs: DataFrame, refs: References | None = None, limits: Limits = LIMITS, guard_words: int = 75) -> DataFrame:
    """The base counts, the nearest language with both distances, and the verdict, for each row."""
    return verdicts(measures(docs, References.of(docs) if refs is None else refs), limits, guard_words)


def fitted(docs: DataFrame, labels: DataFrame, refs: References, guard_words: int = 75, keep_good: float = 0.995) -> Limits:
    """Slopes and limits from all labelled documents. docs: doc_id, text; labels: doc_id, quality (1: good, 0: bad)."""
    return fitted_on(measures(docs, refs), labels, guard_words, keep_good) if refs.shares else LIMITS


def fitted_on(rows: DataFrame, labels: DataFrame, guard_words: int = 75, keep_good: float = 0.995) -> Limits:
    """Slopes and limits from rows of measures: sums for the slopes, and running counts over the sorted distances for the limits,
    in tasks by ranges of them."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    use = rows.where(~F.col("base_failed") & (F.col("n_words") >= guard_words) & F.col("class_distance").isNotNull())
    known = written(use.select("doc_id", "n_words", "class_distance", "word_distance").join(marks, "doc_id").drop("doc_id"), "labelled")
    good, kinds = F.col("quality") == 1, ("class_distance", "word_distance")
    root = 1 / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))
    total = known.agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), *(F.regr_slope(F.when(good, F.col(d)), F.when(good, root)).alias(d) for d in kinds)).first()
    if not total["good"] or not total["bad"]:
        return LIMITS
    slopes = [round(max(0.0, total[d] or 0.0), 9) for d in kinds]  # the last digits depend on the order of the sums
    each = known.select("quality", F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), (-_left(d, slopes[i])).alias("lower")) for i, d in enumerate(kinds)))).alias("x"))
    counts = each.groupBy("x.kind", "x.lower").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    # from the largest distance down
    placed = scan.placed(counts, ["kind"], ["lower"])
    summed = scan.totalled(scan.totalled(placed, ["kind"], ["lower"], "good", "good_upto"), ["kind"], ["lower"], "bad", "bad_upto")
    above, bad_above = F.col("good_upto") - F.col("good"), F.col("bad_upto") - F.col("bad")
    gain = bad_above / F.lit(total["bad"]) - above / F.lit(total["good"])
    places = summed.where((F.col("good") > 0) & (above < total["good"] - int(keep_good * (total["good"] - 1))))
    best = {r["kind"]: r["best"] for r in places.groupBy("kind").agg(F.max(F.struct(gain.alias("gain"), (-F.col("lower")).alias("limit"))).alias("best")).collect()}
    limits = [float(best[i]["limit"]) if best[i]["gain"] > 0 else float("inf") for i in (0, 1)]
    return Limits(slopes[0], limits[0], slopes[1], limits[1])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    refs = References.of(docs)
    rows = written(measures(docs, refs), "measures")
    limits = fitted_on(rows, table(spark, sf_dir, "labels").select("doc_id", "quality")) if refs.shares else LIMITS
    return verdicts(rows, limits)
