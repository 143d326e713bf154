"""The sink by page: resume, force, batches that run again; and the floor of arriving notes against the whole after every batch."""

import json

import pytest

from marginalia.operators import score
from marginalia.sources import notes, page_store
from marginalia.streaming import incremental

P = "book_id string, page_index long"


@pytest.fixture
def store(tmp_path):
    return f"file://{tmp_path}/store"


def rows_of(spark, store, schema):
    return sorted((r["page_index"], r["v"]) for r in page_store.current(spark, store, schema).collect())


def test_resume_force_and_batches_that_run_again(spark, store):
    make = lambda pages, v: spark.createDataFrame([("b", i, v) for i in pages], f"{P}, v string")
    pages = spark.createDataFrame([("b", i) for i in range(600)], P)
    assert page_store.next_batch(spark, store) == 0 and page_store.unfinished(pages, store).count() == 600
    first = make(range(0, 600, 2), "first")
    page_store.put(first, store, 0)
    page_store.put(first, store, 0)  # run again
    page_store.write_data(make(range(1, 100, 2), "killed"), f"{store}/data", 1)  # without a manifest
    left = sorted(r["page_index"] for r in page_store.unfinished(pages, store).collect())
    assert left == list(range(1, 600, 2)) and page_store.next_batch(spark, store) == 1
    page_store.put(make(left, "resumed"), store, 1)  # the killed batch's number again: its rows are replaced
    assert rows_of(spark, store, first.schema) == [(i, "resumed" if i % 2 else "first") for i in range(600)]
    assert page_store.unfinished(pages, store).count() == 0 and page_store.unfinished(pages, store, force=True).count() == 600
    page_store.put(make([5, 8], "forced").union(make([8], "twice")), store, 2)
    assert rows_of(spark, store, first.schema)[5:10] == [(5, "forced"), (6, "first"), (7, "resumed"), (8, "forced"), (8, "twice")]
    assert page_store.unfinished(make([5, 700], ""), store, before=1).count() == 2  # page 5 was finished by later batches only


def note(quotes, refs):
    return json.dumps({"terms": [{"id": "t-a", "label": "a"}], "evidence": [{"id": f"e-{i}", "kind": "text", "source": "body", "excerpt": q} for i, q in enumerate(quotes)], "statements": [{"id": f"s-{i}", "type": "claim", "text": q, "terms": ["t-a"], "evidence": [r]} for i, (q, r) in enumerate(zip(quotes, refs))], "relations": [{"from": "s-0", "to": "t-a", "type": "supports"}]})


def test_the_running_floor_equals_the_floor_of_what_has_come(spark, tmp_path, store):
    norm = spark.createDataFrame([(b, i, f"page {i} has these words", "") for b in "bc" for i in range(4)], f"{P}, body_norm string, foot_norm string")
    expected = spark.createDataFrame([(b, i, True) for b in "bc" for i in range(4)], f"{P}, expected_notes boolean")
    good, bad = lambda i: note([f"page {i}", "these words"], ["e-0", "e-1"]), lambda i: note([f"page {i}", "other words"], ["e-0", "e-7"])
    batches = [[("b", 0, bad(0)), ("b", 1, good(1)), ("c", 0, "{broken")], [("b", 0, good(0)), ("c", 0, bad(0))], [("c", 0, good(0)), ("b", 1, "{broken"), ("c", 3, bad(3))]]
    folder, now, seen = tmp_path / "in", {}, []
    folder.mkdir()
    for n, batch in enumerate(batches):
        (folder / f".{n}").write_text("\n".join(json.dumps({"book_id": b, "page_index": p, "raw": r}) for b, p, r in batch))
        (folder / f".{n}").rename(folder / f"{n}.json")
        incremental.floor_stream(incremental.arriving_notes(spark, str(folder)), norm, store, f"file://{tmp_path}/progress").awaitTermination(120)
        now |= {(b, p): r for b, p, r in batch}
        whole = notes.parsed_notes(spark.createDataFrame([(*k, r) for k, r in now.items()], f"{P}, raw string"))
        counts = incremental.page_counts(whole, norm)
        want = score.floor_book(counts.where("readable").drop("readable"), counts.where("readable").select("book_id", "page_index"), expected)
        got = incremental.running_floor(spark, store, expected)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        seen.append({r["book_id"]: (r["excerpts_anchored"], r["referential_problems"], r["pages_present"]) for r in got.collect()})
    assert seen == [{"b": (3, 1, 2), "c": (0, 0, 0)}, {"b": (4, 0, 2), "c": (1, 1, 1)}, {"b": (2, 0, 1), "c": (3, 1, 2)}]


def test_counts_of_a_page_need_few_scans_and_no_joins_of_flat_tables(spark):
    """As from the flat tables, on notes with every kind of problem."""
    from marginalia.operators import validate

    evidence = [
        {"id": "e-1", "source": "body", "excerpt": "these words"}, {"id": "e-1", "source": "footnote", "excerpt": "these words"}, {"id": None, "kind": "figure", "excerpt": ""}, {"id": "E", "kind": "photo", "source": "margin", "page_index": -1},
        {"id": "e-2", "kind": "text", "excerpt": "other", "source": None, "page_index": 1}, None,
    ]
    statements = [
        {"id": "s-1", "type": "claim", "text": "a", "terms": ["t-a", "t-b", None, "x"], "evidence": ["e-1", "e-9", "e-9", None, "q"]}, {"id": None, "type": "odd", "basis": "none", "terms": None, "evidence": []},
        {"id": "s-1", "type": None, "text": "", "evidence": None}, None,
    ]
    relations = [{"from": "s-1", "to": "t-a", "type": "supports"}, {"from": "s-7", "to": None, "type": "other"}, {"from": "s-7", "to": "S 8"}, None]
    full = {"evidence": evidence, "statements": statements, "relations": relations, "terms": [{"id": "t-a", "label": "a"}, {"id": "T", "label": ""}, {"id": None}, None]}
    made = [full, {k: v for k, v in full.items() if k != "terms"}, {"terms": full["terms"]}, {"statements": statements}, {"evidence": evidence, "relations": relations}, {}, {"evidence": [], "statements": []}]
    raw = spark.createDataFrame([("b", i, json.dumps(m)) for i, m in enumerate(made)] + [("c", 0, "{broken"), ("c", 1, None)], f"{P}, raw string")
    norm = spark.createDataFrame([("b", i, f"page {i} has these words", "") for i in range(3)], f"{P}, body_norm string, foot_norm string")
    rows = notes.parsed_notes(raw.repartition(4, "book_id", "page_index")).persist()
    flat = notes.flattened(rows)
    parts = [flat[k] for k in ("evidence", "statements", "references", "relations", "terms", "statement_terms")]
    problems = validate.reference_problems(*parts), validate.schema(*(flat[k] for k in ("evidence", "statements", "relations", "terms", "statement_terms")))
    want = {(r["book_id"], r["page_index"]): tuple(r[c] for c in score.COUNTS) for r in score.floor_page(flat["evidence"], flat["statements"], *problems, validate.traceability(flat["evidence"], norm)).collect()}
    counts = incremental.page_counts(rows, norm)
    got = {(r["book_id"], r["page_index"]): tuple(r[c] for c in score.COUNTS) for r in counts.collect()}
    assert got == {(r["book_id"], r["page_index"]): want.get((r["book_id"], r["page_index"]), (0,) * 6) for r in raw.collect()} and want[("b", 0)][4] > 5 and want[("b", 0)][5] > 10
    plan = incremental.page_counts(rows, norm)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") <= 4
    rows.unpersist()
