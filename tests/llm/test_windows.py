"""Windows of the substring dedup: chance hits, ranges of hashes, packed rows."""

import collections

import numpy as np
import pyarrow as pa

from marginalia.llm import substring_dedup as sd


def test_windows_with_one_hash_and_other_checks_are_told_apart():
    h = np.array([5, 7, 5, 5, 9, 5], np.uint64)
    check = np.array([1, 1, 2, 1, 1, 2], np.uint32)
    order, new = sd._runs(h, check)
    kinds = np.cumsum(new) - 1
    groups = collections.defaultdict(set)
    for place, i in enumerate(order):
        groups[kinds[place]].add(int(i))
    assert sorted(map(sorted, groups.values())) == [[0, 3], [1], [2, 5], [4]]
    assert sd._marked(h, check, [(np.array([5], np.uint64), np.array([2], np.uint32))]).tolist() == [False, False, True, False, False, True]
    both = [(np.array([5, 5], np.uint64), np.array([2, 1], np.uint32))]
    assert sd._marked(h, np.array([1, 1, 2, 3, 1, 2], np.uint32), both).tolist() == [True, False, True, False, False, True]


def test_checks_are_equal_for_equal_windows_only():
    texts = ["a b c d e f", "x a b c d e f y", "b a c d e f"]
    h, of, first, _, check = sd.window_hashes(pa.array(texts), 3, checked=True)
    words = [t.split() for t in texts]
    seen = {}
    for a, c, d, i in zip(h.tolist(), check.tolist(), of.tolist(), first.tolist()):
        base = sum(len(w) for w in words[:d])
        assert seen.setdefault(tuple(words[d][i - base : i - base + 3]), (a, c)) == (a, c)
    assert len(set(seen.values())) == len(seen)


def test_packs_come_back_as_they_were():
    r = np.random.default_rng(1)
    h, check, ids = r.integers(0, 2**56, 500, dtype=np.uint64), r.integers(0, 2**32, 500, dtype=np.uint32), np.sort(r.integers(-(2**63), 2**62, 500))
    for got, want in zip(sd._unpacked(*sd._packed(h, check, ids)), (h, check, ids)):
        assert (got == want).all()


def test_ranges_of_a_large_part_give_the_same_answers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    asked = sd.requests(docs, 20, 8)

    def answered(at_once):
        out = set()
        for r in sd.answers(asked, 8, 16, at_once).collect():
            h, check, ids = sd._unpacked(bytes(r["hashes"]), r["first"], r["width"], bytes(r["steps"]))
            out |= set(zip([r["part"]] * len(h), [r["high"]] * len(h), h.tolist(), check.tolist(), ids.tolist()))
        return out

    whole = answered(sd.SORTED)
    assert whole and answered(37) == whole
