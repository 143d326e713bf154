"""Steps that several queries share: what they shuffle and how often they run."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.operators import assemble, coverage, dedup, terms, validate
from marginalia.plans.queries import QUERIES

P = "book_id string, page_index long"


@pytest.mark.parametrize("most", [2, 12])
def test_candidates_equal_brute_force_and_a_frequent_term_stays_a_few_rows(spark, most):
    r = random.Random(most)
    rows = [("b", p, f"s-{i}", p // 6, p // 6 != 2, [(t, f"t-{t}") for t in sorted({0, *r.sample(range(1, 40), r.randint(0, 3))})]) for p in range(30) for i in range(4)]
    linked = spark.createDataFrame(rows, f"{P}, statement_id string, chapter_no int, prose boolean, terms array<struct<place:int,term_id:string>>")
    groups = defaultdict(set)
    for _, page, statement, chapter, prose, own in rows:
        for _, term in own if prose else ():
            groups[chapter, term].add((page, statement))
    want = {("b", c, *x) for (c, _), g in groups.items() if 2 <= len(g) <= most and len({p for p, _ in g}) >= 2 for x in g}
    got = terms.relation_candidates(linked, most)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_statements_with_links_are_one_row_each(spark):
    statements = spark.createDataFrame([("b", i, "s-1", f"alpha beta {i % 3}", i // 2) for i in range(9)], f"{P}, statement_id string, text string, chapter_no int")
    store = spark.createDataFrame([("b", "t-z", "alpha", 2), ("b", "t-y", "beta 1", 1), ("b", "t-x", "gamma", 3)], "book_id string, term_id string, key string, place int")
    got = {g["page_index"]: (g["chapter_no"], [t["term_id"] for t in g["terms"]]) for g in terms.linked_statements(statements, store, ("chapter_no",)).collect()}
    assert got == {i: (i // 2, ["t-y", "t-z"] if i % 3 == 1 else ["t-z"]) for i in range(9)}


def test_evidence_is_numbered_without_its_texts(spark):
    members = spark.createDataFrame([("b", 1, 3, "s-1", "p3:s-1", 1, 0, ["e-2", "e-1", "e-2", "e-9"])], "book_id string, chapter_no int, page_index long, statement_id string, key string, final_no int, member_no int, refs array<string>")
    evidence = spark.createDataFrame([("b", 3, e, "text", "body", f"quote {e}") for e in ("e-1", "e-2", "e-3")], f"{P}, evidence_id string, kind string, source string, excerpt string")
    refs, numbers = assemble.evidence_numbers(members, evidence)
    assert "excerpt" not in refs.columns + numbers.columns
    assert sorted((g["evidence_id"], g["evidence_no"], g["excerpt"]) for g in assemble.evidence_records(numbers, evidence).collect()) == [("e-1", 2, "quote e-1"), ("e-2", 1, "quote e-2")]
    assert [g["evidence"] for g in assemble.evidence_lists(refs, numbers).collect()] == [[1, 2, 1]]


def test_coverage_is_worked_out_once_for_the_redo_list(spark):
    seen = spark.sparkContext.accumulator(0)

    def ratio(page):
        seen.add(1)
        return page / 100

    cover = spark.range(10).select(F.lit("b").alias("book_id"), F.col("id").alias("page_index"), F.lit("body").alias("stream")).withColumn("ratio", F.udf(ratio, "double")("page_index"))
    sections = spark.range(10).select(F.lit("b").alias("book_id"), F.col("id").alias("page_index"), F.lit(True).alias("prose"))
    cover = cover.repartition(2)
    assert [g["page_spec"] for g in coverage.redo_list(cover, sections, 0.5).limit(1).collect()] == ["1,2,3,4,5,6,7,8,9,10"]
    assert seen.value <= 30  # a filter and a value for each row, and once more for the bounds of the ranges


def test_clusters_are_worked_out_once(spark, sf, monkeypatch):
    calls, real = [], dedup.clusters
    monkeypatch.setattr(dedup, "clusters", lambda rows: calls.append(1) or real(rows))
    assert QUERIES["c12_apply_adjudication"](spark, sf).count() > 0 and len(calls) == 1


def test_token_sets_are_made_once_and_go_by_number(spark):
    seen = spark.sparkContext.accumulator(0)

    def text(i):
        seen.add(1)
        return " ".join(f"w{j}" for j in range(i % 5, 12))

    rows = spark.range(30).select(F.lit("b").alias("book_id"), (F.col("id") % 15).alias("page_index"), F.lit("s-1").alias("statement_id"), F.udf(text, "string")("id").alias("text"))
    got = {(g["a"], g["b"]): round(g["jaccard"], 3) for g in dedup.similar_texts(rows).collect()}
    first = [f"p{i}:s-1" for i in (0, 1, 10, 11, 12, 13, 14, 2, 3, 4)]
    assert got and all(a in first and v >= 0.8 for (a, _), v in got.items()) and seen.value <= 60


def test_pages_with_loose_references_are_those_with_reference_problems(spark):
    r = random.Random(5)
    pick = lambda of: [("b", p, *(None if r.random() < 0.004 else f"{o}-{r.randrange(9)}" for o in of)) for p in range(80) for _ in range(9) if r.random() < 0.9]
    frame = lambda rows, *names: spark.createDataFrame(rows, ", ".join([P, *(f"{n} string" for n in names)]))
    every = lambda o: [("b", p, f"{o}-{i}") for p in range(80) for i in range(9) if r.random() < 0.99]
    tables = frame(every("e"), "evidence_id"), frame(every("s"), "statement_id"), frame(pick("se"), "statement_id", "evidence_id"), frame(pick("ss") + pick("st"), "src", "dst"), frame(every("t"), "term_id"), frame(pick("st"), "statement_id", "term_id")
    want = {g["page_index"] for g in validate.reference_problems(*tables).select("page_index").collect()}
    got = [g["page_index"] for g in validate.loose_pages(*tables).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < 80


def test_terms_dealt_by_page_are_not_shuffled_to_be_checked(spark):
    empty = lambda *names: spark.createDataFrame([], ", ".join([P, *(f"{n} string" for n in names)]))
    used = spark.createDataFrame([("b", i % 3, f"s-{i}", f"t-{i}") for i in range(9)], f"{P}, statement_id string, term_id string").repartition("book_id", "page_index")
    found = validate.loose_pages(empty("evidence_id"), empty("statement_id"), empty("statement_id", "evidence_id"), empty("src", "dst"), used.select("book_id", "page_index", "term_id").distinct(), used)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0 and not [line for line in plan.splitlines() if "ENSURE_REQUIREMENTS" in line and "term_id" in line]
