"""Two-level scans against plain loops over each group in order."""

import random

import pytest

from marginalia.operators import chapters, scan


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [("a", i, r.randint(-3, 3), r.choice([None, None, "x", "y", "z"]), r.choice("pqr")) for i in range(700)]
    return out + [("b", 3, 1, None, "p"), ("c", 1, None, "x", "q"), ("c", 2, 4, None, "r")]


def test_scans_equal_loops(spark, rows):
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "k string, at long, v long, s string, f string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would come to one task
    try:
        placed = scan.placed(df, ["k"], ["at"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.select(scan.PART).distinct().count() > 3
    out = scan.numbered(placed, ["k"], ["at"], "n")
    out = scan.totalled(out, ["k"], ["at"], "v", "total")
    out = scan.carried(out, ["k"], ["at"], "s", "last")
    out = scan.previous(out, ["k"], ["at"], "f", "before")
    got = {(r["k"], r["at"]): (r["n"], r["total"], r["last"], r["before"]) for r in out.collect()}
    want, state = {}, {}
    for k, at, v, s, f in sorted(rows, key=lambda x: x[:2]):
        n, total, last, before = state.get(k, (0, 0, None, None))
        want[k, at] = (n + 1, total + (v or 0), s or last, before)
        state[k] = (n + 1, total + (v or 0), s or last, f)
    assert got == want


def merged(keys, least=3):
    """The rule from left to right: the longest run over at most two keys, if it has both and is long enough."""
    out, i = [], 0
    while i < len(keys):
        j = i + 1
        while j < len(keys) and len(set(keys[i : j + 1])) <= 2:
            j += 1
        j = j if j - i >= least and len(set(keys[i:j])) == 2 else i + 1
        out.append(list(range(i, j)))
        i = j
    return out


@pytest.mark.parametrize("seed", range(4))
def test_oscillating_chapters_equal_the_rule_from_left_to_right(spark, seed):
    r = random.Random(seed)
    books, rows = {}, []
    for book in ("p", "q", "r"):
        keys = []
        while len(keys) < 120:
            pair = r.sample("ABCD", 2)
            for i in range(r.choice((1, 1, 2, 3, 6))):
                if not keys or keys[-1] != pair[i % 2]:
                    keys.append(pair[i % 2])
        books[book] = keys
        rows += [(book, i + 1, k, k, [i]) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "book_id string, chapter_no long, chapter_key string, title string, pages array<long>")
    got = {}
    for x in chapters.merged_oscillating(df).orderBy("book_id", "chapter_no").collect():
        got.setdefault(x["book_id"], []).append(x["pages"])
    assert got == {b: merged(k) for b, k in books.items()}
