"""Substring dedup and near-duplicate groups against brute force."""

import hashlib
import re

import numpy as np
import xxhash

from marginalia.llm import golay, near_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_removal(docs, window):
    first = {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            f = first[tuple(w[i : i + window])]
            if f != d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_op4_equals_brute_force(spark, sf, docs):
    got = sorted((tuple(r) for r in substring_dedup.op4_substring_dedup(spark, sf).collect()), key=str)
    assert got == expected_removal(docs, 50)


def test_op4_edges(edge, empty):
    rows = substring_dedup.removed(edge)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "ids", "fp", "spans", "n_words", "n_removed", "removed"]
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in rows.collect()]
    plain = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert sorted(got, key=str) == sorted(((d, n, g) for d, n, g, _ in expected_removal(plain, 50)), key=str)
    kept = {r["doc_id"]: r for r in rows.collect()}
    assert kept[2]["text"] is None and kept[3]["text"] == "" and kept[4]["text"] == " \n\t  "
    assert kept[6]["text"] == "before one after one" and [tuple(x) for x in kept[6]["removed"]] == [(2, 72)]
    assert substring_dedup.removed(empty).count() == 0


def test_windows_shorter_than_texts_only(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (2, "x a b c y"), (3, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.removed(rows, window=3).collect()}
    assert got == {1: "a b c d", 2: "x y", 3: "a b"}


def test_golay_code_is_perfect():
    index = golay.indices()
    assert (np.bincount(index) == 2048).all() and len(np.unique(index)) == 4096
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 23, 3000)
    flips = (1 << r.integers(0, 23, 3000)) ^ (1 << r.integers(0, 23, 3000))
    a, b = golay.keys(x), golay.keys(x ^ flips)
    assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist()))


def test_search_keys_find_every_link():
    r = np.random.default_rng(6)
    x = r.integers(0, 2**63, 4000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << r.integers(0, 64, len(x)).astype(np.uint64)
    ka, ra = near_dedup.search_keys(x)
    kb, rb = near_dedup.search_keys(y)
    a = set(zip(ra.tolist(), ka.tolist()))
    met = {row for row, key in zip(rb.tolist(), kb.tolist()) if (row, key) in a}
    assert met == set(range(len(x)))


def roots(fp, bits=4):
    parent = {f: f for f in fp}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    arr = np.array(sorted(set(fp)), np.uint64)
    for i, f in enumerate(arr):
        for g in arr[i + 1 :][np.bitwise_count(arr[i + 1 :] ^ f) <= bits]:
            a, b = root(int(f)), root(int(g))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {f: root(f) for f in parent}


def dense(n, seed):
    """Fingerprints in a few dense balls, so that chains matter."""
    r = np.random.default_rng(seed)
    centre = r.integers(0, 2**63, 6, dtype=np.uint64)[r.integers(0, 6, n)]
    for _ in range(7):
        centre = centre ^ np.where(r.random(n) < 0.7, np.uint64(1) << r.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(centre)


def same_components(pairs, fp):
    want, parent = roots(fp.tolist()), {f: f for f in fp.tolist()}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for u, v in pairs:
        assert bin(u ^ v).count("1") <= 4
        parent[root(u)] = root(v)
    group = {}
    for f in parent:
        group.setdefault(root(f), set()).add(want[f])
    assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(want.values()))


def test_forest_connects_what_links_connect():
    for seed in range(4):
        fp = dense(400, seed)
        u, v = near_dedup.forest(fp)
        assert len(u) < len(fp)
        same_components(zip(u.tolist(), v.tolist()), fp)


def test_large_groups_are_cut_into_blocks(spark):
    fp = dense(1500, 9)
    nodes = spark.createDataFrame([(int(f),) for f in fp.view(np.int64)], "fp long")
    rows = near_dedup.links(nodes, group_limit=32).collect()
    same_components(((r["u"] & (2**64 - 1), r["v"] & (2**64 - 1)) for r in rows), fp)


def simhash(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op9_equals_brute_force(spark, sf, docs):
    fp = {d: simhash(t) for d, t in docs}
    root = roots(list(fp.values()))
    least = {}
    for d in sorted(fp):
        least.setdefault(root[fp[d]], d)
    want = sorted((d, f"{f:016x}", least[root[f]]) for d, f in fp.items())
    assert sorted(tuple(r) for r in near_dedup.op9_near_dedup(spark, sf).collect()) == want


def test_op9_edges(edge, empty):
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in near_dedup.near_groups(edge).collect()]
    assert len(got) == 12
    by_id = {d: (f, c) for d, f, c in got}
    assert by_id[2] == by_id[3] == by_id[4] == (0, 2) and by_id[8][1] == 1 and by_id[None][1] is None or by_id[None][1] in (6, 7)
    assert near_dedup.near_groups(empty).count() == 0
