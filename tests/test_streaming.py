"""The gate as a stream gives what the gate over the whole gives."""

import json

from marginalia.operators import anchor
from marginalia.sources import notes
from marginalia.streaming import incremental

P = "book_id string, page_index long"


def note(quotes):
    return json.dumps({"evidence": [{"id": f"e-{i}", "kind": "text", "source": "body", "excerpt": q} for i, q in enumerate(quotes)], "statements": [{"id": f"s-{i}", "type": "claim", "text": q, "evidence": [f"e-{i}"]} for i, q in enumerate(quotes)], "relations": [{"from": "s-0", "to": "s-1", "type": "supports"}]})


def test_stream_equals_batch(spark, tmp_path):
    norm = spark.createDataFrame([("b", i, f"page {i} has these words", "") for i in range(4)], f"{P}, body_norm string, foot_norm string")
    rows = [("b", i, note([f"page {i}", "these words" if i % 2 else "other words"])) for i in range(4)]
    folder = tmp_path / "in"
    folder.mkdir()

    def arrive(name, part):
        (folder / f".{name}").write_text("\n".join(json.dumps({"book_id": b, "page_index": p, "raw": r}) for b, p, r in part))
        (folder / f".{name}").rename(folder / name)

    def run():
        incremental.gate_stream(incremental.arriving_notes(spark, str(folder), 1), norm, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)

    arrive("1.json", rows[:2])
    run()
    arrive("2.json", [*rows[2:], ("b", 0, note(["late"]))])  # a page that was noted before isn't replaced
    run()
    flat = notes.flattened(notes.parsed_notes(spark.createDataFrame(rows, f"{P}, raw string")))
    flagged = anchor.anchored(flat["evidence"], norm)
    kept = anchor.gate(flagged, flat["statements"], flat["references"], flat["relations"], flat["statement_terms"])
    for name, key, want in (("statements", "statement_id", kept["statements"]), ("relations", "src", kept["relations"]), ("dropped", "id", anchor.dropped(flagged, flat["statements"], flat["references"]))):
        got = spark.read.parquet(str(tmp_path / "out" / name))
        assert sorted((r["page_index"], r[key]) for r in got.collect()) == sorted((r["page_index"], r[key]) for r in want.collect()), name


def test_running_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps(x) for x in ({"book_id": "b", "page_index": 0, "raw": note(["x", "y"])}, {"book_id": "b", "page_index": 1, "raw": "{bad"})))
    q = incremental.running_counts(incremental.arriving_notes(spark, str(folder))).writeStream.format("memory").queryName("running_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("running_counts").collect()] == [("b", 2, 2, 2, 2, 0, 1)]


def test_changed_books(spark):
    pages = spark.createDataFrame([("a", 0, "x", ""), ("a", 1, "y", None), ("b", 0, "z", "")], f"{P}, text string, footnotes string")
    stored = incremental.fingerprints(pages, "low")
    assert incremental.changed(stored, stored).count() == 0
    now = incremental.fingerprints(spark.createDataFrame([("a", 0, "x", ""), ("a", 1, "y!", None), ("b", 0, "z", "")], f"{P}, text string, footnotes string"), "low")
    assert [r["book_id"] for r in incremental.changed(now, stored).collect()] == ["a"]
    assert incremental.changed(incremental.fingerprints(pages, "high"), stored).count() == 2


def test_tables_of_a_batch_are_made_from_what_it_has_written(spark, tmp_path):
    norm = spark.createDataFrame([("b", 0, "page 0 has these words", "")], f"{P}, body_norm string, foot_norm string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"book_id": "b", "page_index": 0, "raw": note(["page 0"])}))
    seen = []
    then = lambda out: seen.extend((name, f) for name, rows in out.items() for f in rows.inputFiles())
    incremental.gate_stream(incremental.arriving_notes(spark, str(tmp_path / "in")), norm, str(tmp_path / "out"), str(tmp_path / "ckpt"), then).awaitTermination(120)
    assert {name for name, _ in seen} == {"evidence", "statements", "relations", "dropped"} and all(f"/out/{name}/batch=0/" in f for name, f in seen)
