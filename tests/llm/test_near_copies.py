"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import near_copies

STAGE = dict(corpus_pipeline.STAGES)["near_dedup"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_ids(rows):
    """The least doc_id of each component; rows: doc_id, text with doc_ids that differ."""
    sets = {}
    for d, t in rows:
        s = shingles(t)
        sets[s] = min(d, sets.get(s, d))
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, b in itertools.combinations(sets, 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            parent[root(a)] = root(b)
    least = {}
    for s, d in sets.items():
        least[root(s)] = min(d, least.get(root(s), d))
    return sorted(least.values())


def test_stage_drops_copies_of_jaccard_from_four_fifths(spark, sf, docs):
    got = STAGE(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(r["doc_id"] for r in got.collect()) == kept_ids(docs)


def test_copies_of_one_text_that_are_less_alike_among_themselves(spark, sf):
    base = [f"w{i}" for i in range(300)]
    rows = [(100, " ".join(base))]
    for i in range(40):  # each shares 0.81 with the base, 0.67 or so with the others
        w = list(base)
        for j in range(6):
            w[(7 * i + 47 * j) % 290 + 3] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    rows += [(200, "one two three"), (201, "One  two three"), (202, "one two four"), (203, None), (204, " ")]
    got = STAGE(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r["doc_id"] for r in got.collect()) == kept_ids(rows) and len(kept_ids(rows)) < 40


def test_rows_of_one_doc_id_with_other_texts_stay(spark, sf):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[3])]
    got = STAGE(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, texts[0]), (1, texts[1]), (None, texts[2]), (2, texts[3])], key=str)


def test_columns_whose_names_clash(spark, sf):
    rows = [(1, "a b c d e f g", "x", "y", "z", "u"), (2, "a b c d e f g", "x", "y", "z", "u"), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of string, row string, mine string, kept_id string")
    got = STAGE(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_rows_alike_but_for_a_column_leave_the_same_one_each_time(spark, sf):
    rows = [(5, "a b c d e f g", lang) for lang in ("en", "fr", "de")] + [(5, "other words here", "en")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [sorted((r["text"], r["lang"]) for r in STAGE(spark, d, sf).collect()) for d in (docs, docs.orderBy("lang"), docs.orderBy(F.desc("lang")))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2


def test_links_within_and_across_blocks_connect_all_alike_nodes():
    """Sets around a base, in components that are known in part; every alike pair whose first shared key this is gets connected."""
    r = np.random.default_rng(2)
    base = np.sort(r.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.sort(np.concatenate([r.choice(base, 300 - n, replace=False), r.integers(0, 2**63, n).astype(np.uint64)])) for n in r.integers(0, 60, 90)]
    minima = near_copies.estimates(np.concatenate(sets), np.arange(91) * 300)
    keys = r.integers(0, 3, (90, 25)) + np.arange(25) * 10  # key 10 * band + value
    group_key = 41
    keys[:, 4] = group_key
    component, block, met = np.where(np.arange(90) < 20, 0, np.arange(90)), np.arange(90) % 2, np.arange(90) % 5 == 0
    table = pa.table({"node": np.arange(90) * 7, "component": component, "minima": [m.tobytes() for m in minima], "set": pa.array([s.view(np.int64).tolist() for s in sets]), "keys": pa.array(keys.tolist()), "block": block, "met": met})
    for a, b in ((0, 0), (1, 1), (0, 1)):
        want = set()
        for i, j in itertools.combinations(range(90), 2):
            shared = len(np.intersect1d(sets[i], sets[j]))
            first = keys[i][np.argmax(keys[i] == keys[j])]
            if sorted((block[i], block[j])) == [a, b] and not (met[i] and met[j]) and first == group_key and component[i] != component[j] and 5 * shared >= 4 * (600 - shared):
                want.add((i, j))
        links = near_copies.Group(table).links(group_key, a, b) // 7
        assert want and all(tuple(sorted(x)) in want for x in links.tolist())
        assert parts(links.tolist(), component) == parts(want, component)


def parts(links, component):
    """The component of each node once links are in."""
    label = list(component)
    for i, j in links:
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    return label


def test_estimates_of_pairs_at_the_limit_pass():
    r = np.random.default_rng(5)
    low = 1.0
    for _ in range(40):
        a = np.sort(r.integers(0, 2**64, 900, dtype=np.uint64))
        b = np.sort(np.concatenate([a[100:], r.integers(0, 2**64, 100, dtype=np.uint64)]))  # 800 of 1000 shared
        e = near_copies.estimates(np.concatenate([a, b]), np.array([0, 900, 1800]))
        low = min(low, (e[0] == e[1]).sum() / near_copies.AGREE)
    assert low >= 1


def test_blocks_of_a_large_group_equal_one_group(spark, sf, monkeypatch):
    r = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in r.choice(200, r.integers(1, 8), replace=False):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    got = STAGE(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r["doc_id"] for r in got.collect()) == kept_ids(rows)
