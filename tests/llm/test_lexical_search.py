"""Lexical search against a plain scoring of every document, and against SQL."""

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import lexical_search as ls

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """Every document's score for every item, term by term."""
    words = [(i, split(t)) for i, t in docs]
    held = [(i, w) for i, w in words if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for place, (i, w) in enumerate(held):
            m = 100 - 50 + (50 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in terms if t in w)
            if s > 0:
                scored.append((-s, i is None, i or 0, place))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(docs, items, **more):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ls.ranked(docs, items, **more).collect()), key=str)


@pytest.mark.parametrize("k, size", [(3, 200), (50, 200), (5, 1 << 20)])
def test_equals_plain_scoring(spark, k, size):
    r = random.Random(k)
    words = ["the", "of", "Ab", "ab", "é1", "漢字", "rare", "x9"] + [f"w{i}" for i in range(40)]
    pick = lambda n: r.choice([" ", "-", "\n", "\x00", "_"]).join(r.choices(words, [60, 50, 9, 9, 5, 5, 1, 1] + [3] * 40, k=n))
    docs = [(r.choice([i, i, i, None]), pick(r.randint(0, 30))) for i in range(300)] + [(900, None), (901, ""), (902, "...")] + [(903, "rare the rare")] * 8
    items = [(i, pick(r.randint(1, 12))) for i in range(25)] + [(3, "rare"), (None, "x9 the"), (50, None), (51, "!!"), (52, "unknown term")]
    got_ = got(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=k, segment_bytes=size, block_items=11)
    assert got_ == plain(docs, items, k)


def test_equals_sql_on_the_small_corpus(spark, sf):
    from marginalia.llm.registry import queries

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rows = queries()["op11_lexical_search"](spark, sf)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, c.sql(ls.ORACLE_SQL).df()[rows.columns].itertuples(index=False)))


def test_pair_bounds_hold_and_are_tighter(spark, sf):
    """No document is above a bound; and pairs bring bounds below the sums of the terms' own maxima."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(8).collect()]
    terms = sorted({t for x in texts for t in ls.terms_of(x)})
    parts = ls.segments(docs.coalesce(1), terms)
    row = parts.collect()[0]
    df = dict(zip(row["term"], row["df"]))
    weights = np.array([ls.weight(row["holding"], df.get(i, 0)) for i in range(len(terms))])
    orders = [np.array(sorted((terms.index(t) for t in ls.terms_of(x) if terms.index(t) in df), key=lambda i: (weights[i], i))) for x in texts]
    pairs = sorted({p for o in orders for p in zip(o.tolist(), o[1:].tolist())})
    place = {p: i for i, p in enumerate(pairs)}
    indexed = ls.index(parts, weights, np.array(pairs), row["holding"], row["total"]).collect()[0]
    segment, tighter = ls.Segment(indexed.asDict(), weights, len(pairs)), 0
    for order in orders:
        own = np.array([place[p] for p in zip(order.tolist(), order[1:].tolist())], int)
        bounds = segment.bounds(order, own)
        for i in range(1, len(order) + 1):
            score = np.zeros(segment.rows, np.int64)
            for t in order[:i].tolist():
                d, x = segment.postings(t)
                np.add.at(score, d, x)
            assert score.max() <= bounds[i] <= segment.most[order[:i]].sum()
        tighter += bounds[-1] < segment.most[order].sum()
    assert tighter


def test_terms_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(ls.ws, "hashes", lambda key, size, seed=0: np.zeros(len(size), np.uint64))
    terms = [b"a", b"bb", b"ccc", b"d" * 40]
    asked = ls.Asked(terms)
    buf, start, end, _ = ls.term_spans(pa.array([f"bb zz {'d' * 40} a {'d' * 41} ccc"]))
    assert asked.find(*ls.ws.keys(buf, start, end)).tolist() == [1, -1, 3, 0, -1, 2]


def test_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "fox dog"), (2, None), (1, "shared1")], "item_id long, text string")
    rows = edge.collect()
    assert got(edge, items) == plain([(r["doc_id"], r["text"]) for r in rows], [(1, "fox dog"), (2, None), (1, "shared1")], 50)
    assert ls.ranked(empty, items).count() == 0
    assert ls.ranked(edge, items.limit(0)).count() == 0
