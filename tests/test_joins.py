"""Band join, sweep, runs of letters and rounding against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import coverage, export, layout, terms
from marginalia.operators.boxes import points_in_boxes
from marginalia.plans import queries
from marginalia.plans.queries import QUERIES
from marginalia.sources import derived

P = "book_id string, page_index long"


def test_points_in_boxes_equals_all_pairs(spark):
    r = random.Random(1)
    boxes = [("b", r.randint(0, 2), i, *sorted(r.choices(range(-40, 120), k=2)), *sorted(r.choices(range(-40, 120), k=2))) for i in range(120)] + [("b", 0, 900, None, 3, 0, 1), ("b", 0, 901, 9, 3, 0, 1)]
    points = [("b", r.randint(0, 2), i, r.randint(-40, 120) / 2, r.randint(-40, 120) / 2) for i in range(150)] + [("b", 0, 900, None, 1.0)]
    a = spark.createDataFrame([(*x[:3], *(None if v is None else float(v) for v in x[3:])) for x in boxes], f"{P}, box int, l double, r double, t double, b double")
    p = spark.createDataFrame(points, f"{P}, point int, px double, py double")
    got = points_in_boxes(a, p, ["book_id", "page_index"], (F.col("l"), F.col("r"), F.col("px")), (F.col("t"), F.col("b"), F.col("py")), (7.0, 11.0))
    want = sorted((x[2], y[2]) for x in boxes for y in points if x[1] == y[1] and None not in (x[3], y[3]) and x[3] <= y[3] <= x[4] and x[5] <= y[4] <= x[6])
    assert sorted((g["box"], g["point"]) for g in got.collect()) == want


def test_signs_in_gaps(spark):
    words = [("b", 0, i, "w", float(x), x + 10.0, 0.0, 10.0, 10.0) for i, x in enumerate((0, 20, 31, 200))]
    lined = layout.lined(spark.createDataFrame(words, f"{P}, word_no long, text string, x0 double, x1 double, top double, bottom double, size double"))
    shapes = [("b", 0, 0, 12.0, 14.0, 4.0, 6.0), ("b", 0, 1, 30.0, 31.0, 4.0, 6.0), ("b", 0, 2, 100.0, 120.0, 4.0, 6.0), ("b", 0, 3, 100.0, 120.0, 40.0, 60.0), ("b", 1, 4, 12.0, 14.0, 4.0, 6.0)]
    drawn = spark.createDataFrame(shapes, f"{P}, shape_no long, x0 double, x1 double, top double, bottom double")
    found = layout.gap_shapes(lined, drawn)
    assert sorted((g["gap_no"], g["shape_no"]) for g in found.collect()) == [(1, 0), (3, 2)]
    points = spark.createDataFrame([("b", 0, 0, 1.0, 1.0), ("b", 0, 0, 3.0, 2.0)], f"{P}, shape_no long, x double, y double")
    ids = {g["gap_no"]: g["glyph_id"] for g in layout.gap_glyphs(found, points).collect()}
    assert ids[3] == "00000000" != ids[1] and len(ids[1]) == 8


def test_covered_parts_equals_sums_of_overlaps(spark):
    r = random.Random(2)
    parts, merged = [], []
    for page in range(30):
        cuts = sorted(r.sample(range(300), 2 * r.randint(0, 12)))
        merged += [("b", page, "body", a, b) for a, b in zip(cuts[::2], cuts[1::2])]
        parts += [("b", page, "body", i, f"s{i}", a, a + r.randint(1, 60)) for i, a in enumerate(r.choices(range(280), k=15))]
    p = spark.createDataFrame(parts, f"{P}, stream string, sent_no int, sent string, a long, b long")
    m = spark.createDataFrame(merged, f"{P}, stream string, start_at long, end_at long")
    got = {(g["page_index"], g["sent_no"]): (g["sent"], g["a"], g["b"], g["covered"]) for g in coverage.covered_parts(p, m, "sent_no", "sent").collect()}
    assert got == {(x[1], x[3]): (x[4], x[5], x[6], sum(max(0, min(x[6], y[4]) - max(x[5], y[3])) for y in merged if y[1] == x[1])) for x in parts}


def test_a_stream_without_quotes_is_all_gaps(spark):
    norm = spark.createDataFrame([("b", 0, "One sentence stands here. Another one stands here.", "")], f"{P}, body_norm string, foot_norm string")
    none = spark.createDataFrame([], f"{P}, stream string, start_at int, end_at int")
    assert [(g["sent_no"], g["coverage"]) for g in coverage.gaps(norm, none).orderBy("sent_no").collect()] == [(0, 0.0), (1, 0.0)]


def test_rounding_equals_pythons(spark):
    pairs = [(c, n) for n in range(1, 400) for c in range(n + 1)]
    rows = spark.createDataFrame(pairs, "c long, n long").select("c", "n", *(T.rounded(F.col("c").cast("double") / F.col("n"), k).alias(f"r{k}") for k in (2, 3)))
    for g in rows.collect():
        assert (g["r2"], g["r3"]) == (round(g["c"] / g["n"], 2), round(g["c"] / g["n"], 3))


def test_links_equal_containment(spark):
    r = random.Random(3)
    words = ["ab", "abc", "bca", "cab", "x", "tion", "station", "q"]
    texts = [("b" + str(i % 2), i, "s-1", " ".join(r.choices(words, k=r.randint(0, 6)))) for i in range(80)]
    keys = [("b0", "t-1", "ab"), ("b0", "t-2", "abc bca"), ("b0", "t-3", "x"), ("b0", "t-4", "tion st"), ("b1", "t-1", "cab"), ("b1", "t-5", "nowhere"), ("b0", "t-6", ""), ("b1", "t-7", "tionx")]
    statements = spark.createDataFrame(texts + texts[:3], f"{P}, statement_id string, text string")
    store = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "book_id string, term_id string, key string, place int")
    keyed = {(g["book_id"], g["page_index"]): g["k"] for g in statements.select("book_id", "page_index", T.term_key(F.col("text")).alias("k")).collect()}
    want = sorted((b, p, t) for (b, p), text in keyed.items() for c, t, k in keys if b == c and k and k in text)
    assert sorted((g["book_id"], g["page_index"], g["term_id"]) for g in terms.link_terms(statements, store).collect()) == want
    assert terms.link_terms(statements, store.limit(0)).count() == 0


def test_equal_statements_give_a_link_each_and_alike_ones_the_links_of_their_first(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = ["all the same words here"] * 40
    for _ in range(25):
        base = r.sample(words, r.randint(4, 20))
        texts += [" ".join(base), " ".join(base[::-1]), " ".join(base[1:]), " ".join([*base, "more"])]
    texts += ["", "x", "X"]
    from marginalia.operators import dedup

    df = spark.createDataFrame([("b", i, f"s-{i}", t) for i, t in enumerate(texts)], f"{P}, statement_id string, text string")
    sets = {}
    for i, t in enumerate(texts):
        if t:
            sets.setdefault(frozenset(t.lower().split()), []).append(f"p{i}:s-{i}")
    want = {(min(m), x): 1.0 for m in sets.values() for x in m if x != min(m)}
    known = list(sets)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if len(a & b) >= 0.8 * len(a | b):
                want[tuple(sorted((min(sets[a]), min(sets[b]))))] = len(a & b) / len(a | b)
    for block in (2000, 3):
        got = {(g["a"], g["b"]): g["jaccard"] for g in dedup.similar_texts(df, block=block).collect()}
        assert got == want and sum(v == 1.0 for v in got.values()) == sum(len(m) - 1 for m in sets.values())


def test_clusters_by_size_and_members_by_page(spark):
    from marginalia.operators import dedup

    rows = [("b/p10:s-1", "b/p10:s-1"), ("b/p2:s-1", "b/p10:s-1"), ("b/p2:s-12", "b/p10:s-1"), ("b/p2:s-9", "b/p10:s-1"), ("b/p1:s-1", "b/p1:s-1"), ("b/p3:s-1", "b/p1:s-1"), ("c/p1:s-1", "c/p1:s-1"), ("c/p3:s-1", "c/p1:s-1")]
    got = sorted(map(tuple, dedup.cluster_lists(spark.createDataFrame(rows, "node string, cluster string")).collect()))
    assert got == [("b", 1, "b/p10:s-1", 4, "b/p2:s-1 b/p2:s-9 b/p2:s-12 b/p10:s-1"), ("b", 2, "b/p1:s-1", 2, "b/p1:s-1 b/p3:s-1"), ("c", 1, "c/p1:s-1", 2, "c/p1:s-1 c/p3:s-1")]


@pytest.mark.parametrize("most", [1, 2, 7])
def test_links_by_blocks_move_statements_and_terms_alone(spark, most):
    r = random.Random(most)
    words = ["ab", "abc", "bca", "cab", "x", "tion", "station", "q"]
    texts = [("b" + str(i % 3), i, f"s-{i % 4}", " ".join(r.choices(words, k=r.randint(0, 6)))) for i in range(120)]
    keys = [(f"b{b}", f"t-{i}", k) for b in (0, 1) for i, k in enumerate(["ab", "abc bca", "x", "tion st", "station", "abcd"][: 6 - 3 * b])]
    statements = spark.createDataFrame([*texts, *texts[:5], ("b0", None, "s-1", "ab"), (None, 1, "s-1", "ab"), ("b0", 500, "s-1", None)], f"{P}, statement_id string, text string")
    store = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "book_id string, term_id string, key string, place int")
    keyed = {(g["book_id"], g["page_index"], g["statement_id"]): g["k"] for g in statements.where("page_index < 500").select("book_id", "page_index", "statement_id", T.term_key(F.col("text")).alias("k")).collect()}
    want = sorted((b, p, s, t) for (b, p, s), text in keyed.items() for c, t, k in keys if b == c and k in text)
    assert sorted(tuple(g)[:4] for g in terms.link_terms(statements, store, most=most).collect()) == want
    dealt = {g["book_id"]: g["blocks"] for g in terms.blocks(statements, store, most).collect()}
    own, named = {b: sum(t[0] == b for t in statements.collect()) for b in dealt}, {b: sum(k[0] == b for k in keys) for b in dealt}
    assert set(dealt) == {"b0", "b1"} and all(dealt[b] * named[b] <= own[b] + named[b] for b in dealt)


def test_page_and_file_numbers_of_any_length_stay_whole(spark, tmp_path):
    spark.range(10_003).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit("src0").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["s3_page_index_of"](spark, str(tmp_path)).where("page_index % 5 <> 4 and parsed <> page_index").count() == 0
    chapters = spark.createDataFrame([("b", n, "t") for n in (7, 100, 1000, 1001)], "book_id string, file_no int, title string")
    none = spark.createDataFrame([], "book_id string, file_no int, line_no int, level int, number string, title string, anchor string")
    assert {g["anchor"] for g in export.book_toc(chapters, none).collect()} == {"c007-chap", "c100-chap", "c1000-chap", "c1001-chap"}


def test_words_dealt_by_page_are_not_shuffled_again(spark):
    row = f"{P}, word_no long, text string, x0 double, x1 double, top double, bottom double, size double, column_no int"
    made = [("b", i % 3, i, f"w{i}", 9.0 * (i % 7), 9.0 * (i % 7) + 5, 4.0 * (i // 9), 4.0 * (i // 9) + 3, 10.0, i % 2) for i in range(90)]
    words = spark.createDataFrame(made, row).repartition("book_id", "page_index")
    shapes = words.select("book_id", "page_index", F.col("word_no").alias("shape_no"), (F.col("x0") - 3).alias("x0"), (F.col("x0") - 1).alias("x1"), "top", "bottom")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (layout.lines(layout.lined(words)), layout.lines(layout.lined(words, ["book_id", "page_index", "column_no"]), ["book_id", "page_index", "column_no"]), layout.gap_shapes(layout.lined(words), shapes)):
            assert "ENSURE_REQUIREMENTS" not in frame._jdf.queryExecution().executedPlan().toString()
            assert frame.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_texts_are_dealt_over_tasks_by_their_characters(spark, tmp_path, monkeypatch):
    spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.lit(20)).alias("text"), F.lit("src0").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(derived, "PART_CHARS", 100)
    dealt = queries.words(derived.Corpus(spark, str(tmp_path)))
    assert dealt.rdd.getNumPartitions() == 41 and dealt.count() == 800


def test_boxes_of_any_width_meet_points_without_a_row_for_each_cell(spark):
    boxes = spark.createDataFrame([("b", 0, "wide", -1e12, 1e12, 0.0, 5.0), ("b", 0, "far", 0.0, float("inf"), 0.0, float("inf")), ("b", 1, "none", 0.0, 1.0, 0.0, 1.0)], f"{P}, box string, l double, r double, t double, b double")
    points = spark.createDataFrame([("b", 0, 1, -9e11, 5.0), ("b", 0, 2, 3.0, 0.0), ("b", 0, 3, 3.0, 1e13), ("b", 0, 4, None, 1.0), ("b", 2, 5, 0.5, 0.5)], f"{P}, point int, px double, py double")
    got = points_in_boxes(boxes, points, ["book_id", "page_index"], (F.col("l"), F.col("r"), F.col("px")), (F.col("t"), F.col("b"), F.col("py")), (64.0, 12.0))
    assert sorted((r["box"], r["point"]) for r in got.collect()) == [("far", 2), ("far", 3), ("wide", 1), ("wide", 2)]


def test_words_are_split_within_their_pages_row(spark):
    row = f"{P}, word_no int, text string, x0 double, x1 double, top double, bottom double, size double, note string"
    words = spark.createDataFrame([("b", 0, 0, "ab", 0.0, 1e12, 0.0, 10.0, 0.0, "n"), ("b", 0, 1, "cd", 0.0, 50.0, 20.0, 30.0, None, None), ("b", 1, 0, "e", 0.0, 9.0, 0.0, 10.0, 10.0, "m")], row).repartition("book_id", "page_index")
    chars = spark.createDataFrame([("b", 0, "b", 40.0, 48.0, 1.0, None), ("b", 0, "a", 0.0, 8.0, 0.0, 0.0), ("b", 0, "d", 9.7, 17.0, 20.0, 10.0), ("b", 0, "c", 0.0, 8.0, 20.0, 10.0), ("b", 0, "z", 60.0, 61.0, 20.0, 10.0), ("b", 2, "y", 0.0, 1.0, 0.0, 1.0)], f"{P}, text string, x0 double, x1 double, top double, size double").repartition("book_id", "page_index")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = layout.split_words(words, chars)
        assert "ENSURE_REQUIREMENTS" not in cut._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["page_index"], r["word_no"], r["part"], r["text"], r["x0"], r["x1"], r["note"]) for r in cut.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == [(0, 0, 0, "a", 0.0, 8.0, "n"), (0, 0, 1, "b", 40.0, 48.0, "n"), (0, 1, 0, "cd", 0.0, 50.0, None), (1, 0, 0, "e", 0.0, 9.0, "m")]


def test_lines_are_found_by_search_and_equal_a_fold_over_heights(spark):
    tops = [(k * 17 % 101) * 0.7 + (400.0 if k % 3 else 0.0) for k in range(300)] + [None, 12.0]
    made = [("b", k % 2, k, "7" if k % 5 else "w", 1.0 * k, k + 0.5, t, None if t is None else t + 9, (10.0, 7.0, 0.0, None)[k % 4], k % 3 % 2) for k, t in enumerate(tops)]
    words = spark.createDataFrame(made, f"{P}, word_no int, text string, x0 double, x1 double, top double, bottom double, size double, column_no int")
    for keys in (["book_id", "page_index"], ["book_id", "page_index", "column_no"]):
        want = {}
        for key in {(w[1], w[9]) if len(keys) > 2 else (w[1],) for w in made}:
            first, n = None, 0
            for t in sorted({w[6] for w in made if w[6] is not None and (w[1], w[9])[: len(key)] == key}):
                if first is None or t - first > layout.LINE_TOLERANCE:
                    first, n = t, n + 1
                want[(*key, t)] = (n, first)
        frame = layout.lined(words, keys)
        got = frame.collect()
        assert len(got) == len(made) - 1 and all((r["line_no"], r["line_top"]) == want[(*(r[k] for k in keys[1:]), r["top"])] for r in got)
        if len(keys) == 2:  # no list of all heights is gone through
            assert "array_position" not in frame._jdf.queryExecution().optimizedPlan().toString()
        rows, counted = {(*(r[k] for k in keys), r["line_no"]): r for r in layout.lines(frame, keys).collect()}, layout.line_sizes(layout.heights(words, keys), keys).collect()
        assert len(rows) == len(counted)
        for r in counted:
            line = rows[(*(r[k] for k in keys), r["line_no"])]
            assert (r["line_top"], r["line_bottom"], r["line_size"], r["n_words"]) == (line["line_top"], line["line_bottom"], line["line_size"], line["n_words"])
            assert r["label"] == (line["n_words"] == 1 and line["line_text"] == "7")


def test_texts_are_measured_once_before_they_become_words(spark, sf):
    plan = queries.words(derived.Corpus(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    explode = next(line for line in plan.splitlines() if "Generate posexplode" in line)
    above = plan.split(explode)[0]
    assert "length(text" not in above and "substring_index" not in above


def test_headers_from_counted_heights_equal_those_from_lines(spark, sf):
    c = derived.Corpus(spark, sf)
    words = queries.words(c)
    want = layout.header_bottoms(layout.lines(layout.lined(words)), layout.body_size(words))
    counted = layout.heights(layout.columns(words, queries.gutters(c)), ["book_id", "page_index", "column_no"])
    got = layout.header_bottoms(layout.line_sizes(counted), layout.size_medians(counted))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()
