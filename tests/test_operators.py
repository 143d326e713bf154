"""Operators on rows with expected values written by hand, and rules that hold for any input."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import anchor, assemble, chapters, components, cost, coverage, dedup, layout, locate, propose, score, terms, validate
from marginalia.sources import notes

P = "book_id string, page_index long"
EVIDENCE = f"{P}, evidence_id string, kind string, source string, excerpt string, page_override long"


@pytest.fixture(scope="module")
def gate_tables(spark):
    norm = spark.createDataFrame([("b", 0, "the body of it", "a foot note"), ("b", 1, "second page", "")], f"{P}, body_norm string, foot_norm string")
    evidence = spark.createDataFrame([("b", 0, "e-1", "text", "body", "the body", None), ("b", 0, "e-2", "text", "body", "spoilt", None), ("b", 0, "e-3", None, None, "foot note", None), ("b", 0, "e-4", "figure", None, None, None), ("b", 0, "e-5", "text", "body", "second page", 1), ("b", 0, "e-6", "text", "body", " ", None), ("b", 0, "e-7", "text", "body", "x", 9)], EVIDENCE)
    statements = spark.createDataFrame([("b", 0, "s-1", "claim", "author", "one", ["e-1", "e-2"]), ("b", 0, "s-2", "claim", None, "two", ["e-2"]), ("b", 0, "s-3", "odd", None, "", ["e-9"]), ("b", 0, "s-4", "method", None, "four", ["e-3", "e-4"])], f"{P}, statement_id string, type string, basis string, text string, refs array<string>")
    references = statements.select("book_id", "page_index", "statement_id", F.posexplode("refs").alias("pos", "evidence_id"))
    relations = spark.createDataFrame([("b", 0, "s-1", "s-4", "supports"), ("b", 0, "s-1", "s-2", "supports"), ("b", 0, "s-1", "t-a", "defines"), ("b", 0, "s-9", "t-b", "defines")], f"{P}, src string, dst string, rel_type string")
    return norm, evidence, statements, references, relations


def test_gate(spark, gate_tables):
    norm, evidence, statements, references, relations = gate_tables
    flagged = anchor.anchored(evidence, norm)
    assert {r["evidence_id"]: r["anchored"] for r in flagged.collect()} == {"e-1": True, "e-2": False, "e-3": True, "e-4": True, "e-5": False, "e-6": True, "e-7": False}
    used = spark.createDataFrame([("b", 0, "s-1", "t-a"), ("b", 0, "s-2", "t-b")], f"{P}, statement_id string, term_id string")
    kept = anchor.gate(flagged, statements, references, relations, used)
    assert {r["statement_id"]: r["refs"] for r in kept["statements"].collect()} == {"s-1": ["e-1"], "s-4": ["e-3", "e-4"]}
    assert sorted(r["evidence_id"] for r in kept["evidence"].collect()) == ["e-1", "e-3", "e-4"]
    assert sorted((r["src"], r["dst"]) for r in kept["relations"].collect()) == [("s-1", "s-4"), ("s-1", "t-a")]
    assert sorted(r["id"] for r in anchor.dropped(flagged, statements, references).collect()) == ["e-2", "e-5", "e-7", "s-2", "s-3"]
    again = anchor.gate(flagged, kept["statements"], anchor.kept_references(references, flagged), kept["relations"], used)
    assert again["statements"].count() == 2 and again["relations"].count() == 2


def test_problems(gate_tables):
    norm, evidence, statements, references, relations = gate_tables
    assert sorted((r["rule"], r["item"]) for r in validate.traceability(evidence, norm).collect()) == [("missing page", "e-7"), ("not found", "e-2")]
    assert sorted((r["rule"], r["item"], r["detail"]) for r in validate.reference_problems(evidence, statements, references, relations).collect()) == [("missing evidence", "s-3", "e-9"), ("unknown endpoint", "s-1", "t-a"), ("unknown endpoint", "s-9", "s-9"), ("unknown endpoint", "s-9", "t-b")]
    spark = evidence.sparkSession
    terms = spark.createDataFrame([("b", 0, "t-a", "a"), ("b", 0, "x", "")], f"{P}, term_id string, label string")
    used = spark.createDataFrame([("b", 0, "s-1", "t-a"), ("b", 0, "s-1", "t-none"), ("b", 0, "s-2", "e-1")], f"{P}, statement_id string, term_id string")
    more = sorted((r["rule"], r["item"], r["detail"]) for r in validate.reference_problems(evidence, statements, references, relations, terms, used).collect())
    assert more == [("missing evidence", "s-3", "e-9"), ("missing term", "s-1", "t-none"), ("missing term", "s-2", "e-1"), ("unknown endpoint", "s-9", "s-9"), ("unknown endpoint", "s-9", "t-b")]
    extra = [(r["rule"], r["item"], r["detail"]) for r in validate.schema(evidence, statements, relations, terms, used).subtract(validate.schema(evidence, statements, relations)).collect()]
    assert sorted(extra) == [("id", "x", "x"), ("label", "x", "empty"), ("reference", "s-2", "e-1")]
    found = sorted((r["rule"], r["item"]) for r in validate.schema(evidence, statements, relations).collect())
    assert found == [("source", "e-3"), ("text", "s-3"), ("type", "s-3")]


def test_coverage_of_touching_and_nested_quotes(spark):
    norm = spark.createDataFrame([("b", 0, "abcdefghij klm. Nothing of this is quoted here.", ""), ("b", 1, "", "")], f"{P}, body_norm string, foot_norm string")
    quotes = [("abc",), ("def",), ("bcd",), ("zz",), (" ",), ("klm.",)]
    evidence = spark.createDataFrame([("b", 0, f"e-{i}", "text", "body", q, None) for i, (q,) in enumerate(quotes)], EVIDENCE)
    merged = coverage.intervals(coverage.covered_spans(evidence, norm))
    assert sorted((r["start_at"], r["end_at"]) for r in merged.collect()) == [(0, 6), (11, 15)]
    cover = {(r["page_index"], r["stream"]): r for r in coverage.coverage(norm, merged).collect()}
    assert cover[0, "body"]["covered_chars"] == 10 and cover[1, "body"]["ratio"] == 1.0
    gap = coverage.gaps(norm, merged).collect()
    assert [r["text"] for r in gap] == ["Nothing of this is quoted here."]


def test_header_rules_and_title(spark):
    tops = ["", "ONE OFF", "CHAPTER 5", "my book", "CHAPTER 5: SISTERS", "my book", "small", "CHAPTER 6"]
    heads = spark.createDataFrame([("b", i, t) for i, t in enumerate(tops)], f"{P}, top_line string")
    assert chapters.book_title(heads).first()["title"] == "my book"
    rows = chapters.chapters(chapters.grouped(heads)).orderBy("chapter_no").collect()
    assert [(r["chapter_key"], r["title"], r["pages"]) for r in rows] == [("FRONT-MATTER", "Front matter", [0]), ("ONE OFF", "ONE OFF", [1]), ("CHAPTER 5", "CHAPTER 5: SISTERS", [2, 3, 4, 5, 6]), ("CHAPTER 6", "CHAPTER 6", [7])]
    lone = spark.createDataFrame([("b", 0, "CHAPTER 1")], f"{P}, top_line string")
    assert chapters.chapters(chapters.grouped(lone)).first()["chapter_key"] == "FRONT-MATTER"


def runs(spark, keys):
    rows = spark.createDataFrame([("b", i + 1, k, k.title(), [i]) for i, k in enumerate(keys)], "book_id string, chapter_no long, chapter_key string, title string, pages array<long>")
    return [(r["chapter_key"], r["pages"]) for r in chapters.merged_oscillating(rows).orderBy("chapter_no").collect()]


def test_oscillating_runs(spark):
    assert runs(spark, ["A", "B", "A"]) == [("A", [0, 1, 2])]
    assert runs(spark, ["A", "B"]) == [("A", [0]), ("B", [1])]
    assert runs(spark, ["A", "T: x", "A", "C", "A", "C"]) == [("T: x", [0, 1, 2]), ("C", [3, 4, 5])]
    assert runs(spark, ["A", "B", "C", "B", "C"]) == [("A", [0]), ("B", [1, 2, 3, 4])]


def test_strays_and_contents(spark):
    schema = "book_id string, chapter_no long, chapter_key string, title string, pages array<long>"
    rows = spark.createDataFrame([("b", 1, "TABLE L", "TABLE L", [0]), ("b", 2, "FAMILY", "FAMILY", [1, 2]), ("b", 3, "TABLE M", "TABLE M", [3]), ("b", 4, "CHAPTER 1", "CHAPTER 1", [4]), ("b", 5, "TABLE N", "TABLE N", [5])], schema)
    assert [(r["title"], r["pages"]) for r in chapters.absorbed_strays(rows).orderBy("chapter_no").collect()] == [("TABLE L", [0, 1, 2]), ("TABLE M", [3]), ("CHAPTER 1", [4]), ("TABLE N", [5])]
    book = spark.createDataFrame([("b", 1, "CONTENTS", "TABLE OF CONTENTS", [0]), ("b", 2, "CHAPTER 1", "CHAPTER 1", [1]), ("b", 3, "CHAPTER 2", "CHAPTER 2: HAS ONE", [2])], schema)
    pages = spark.createDataFrame([("b", 0, "CHAPTER 1 Aims and ends: more ..... 7\nCHAPTER 1 Other\nCHAPTER 2 Two ... 9", "")], f"{P}, body string, footnotes string")
    assert [r["title"] for r in chapters.titled_from_contents(book, pages).orderBy("chapter_no").collect()] == ["TABLE OF CONTENTS", "CHAPTER 1: Aims and ends", "CHAPTER 2: HAS ONE"]


def test_stitches_cross_only_neighbouring_text_pages(spark):
    body = {0: "First. It goes on", 1: "to here. Then.", 2: "It goes on", 4: "never joined."}
    pages = spark.createDataFrame([("b", i, t, "text") for i, t in body.items()], f"{P}, body string, page_type string")
    norm = pages.select("book_id", "page_index", "page_type", F.col("body").alias("body_norm"))
    evidence = spark.createDataFrame([("b", 0, "e-1", "text", "body", "It goes on", None), ("b", 0, "e-2", "text", "body", "First.", None), ("b", 2, "e-3", "text", "body", "It goes on", None)], EVIDENCE)
    assert [(r["evidence_id"], r["stitched"]) for r in chapters.stitches(evidence, pages, norm).collect()] == [("e-1", "It goes on to here.")]


def test_components_of_random_graphs(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {n: n for e in edges if e[0] != e[1] for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_dedup_chain_and_types(spark):
    quotes = {"e-1": "a" * 25, "e-2": "b" * 30, "e-3": "c" * 24}
    evidence = spark.createDataFrame([("b", p, e, "text", "body", q, None) for p in range(4) for e, q in quotes.items()], EVIDENCE)
    s = [(0, "s-1", "claim", ["e-1"]), (1, "s-1", "claim", ["e-1", "e-2"]), (2, "s-1", "claim", ["e-2"]), (3, "s-1", "method", ["e-2"]), (3, "s-2", "claim", ["e-3"])]
    statements = spark.createDataFrame([("b", p, i, t, r) for p, i, t, r in s], f"{P}, statement_id string, type string, refs array<string>")
    references = statements.select("book_id", "page_index", "statement_id", F.posexplode("refs").alias("pos", "evidence_id"))
    members = dedup.clusters(dedup.edges(dedup.cited_quotes(statements, references, evidence)))
    assert sorted(r["node"] for r in members.collect()) == ["b/p0:s-1", "b/p1:s-1", "b/p2:s-1"]
    cluster = members.first()["cluster"]
    wanted = spark.createDataFrame([(cluster, 1, "b/p0:s-1", "t"), (cluster, 1, "b/p3:s-2", "t"), (cluster, 2, "b/p1:s-1", "u"), (cluster, 2, "b/p2:s-1", "u")], "cluster string, merge_no int, node string, text string")
    assert sorted(r["node"] for r in dedup.accepted(members, wanted).collect()) == ["b/p1:s-1", "b/p2:s-1"]


def test_assembly_order_and_shared_merges(spark):
    schema = f"{P}, statement_id string, type string, basis string, text string, refs array<string>"
    statements = spark.createDataFrame([("b", 1, f"s-{i}", "claim", None, f"t{i}", ["e-1", f"e-{i}"]) for i in (1, 2, 10, 11)], schema)
    sections = spark.createDataFrame([("b", 1, 1)], f"{P}, chapter_no long")
    merges = spark.createDataFrame([("b", 0, "p1:s-1", "first", 1), ("b", 0, "p1:s-2", "first", 2), ("b", 1, "p1:s-2", "second", 1), ("b", 1, "p1:s-11", "second", 2), ("b", 2, "p1:s-10", "alone", 1), ("b", 2, "p9:s-9", "alone", 2)], "book_id string, merge_no int, key string, text string, member_no int")
    finals, members = assemble.chapter_statements(statements, sections, merges)
    assert [(r["final_no"], r["text"]) for r in finals.orderBy("final_no").collect()] == [(1, "first"), (2, "t10"), (3, "second")]
    assert {r["key"]: r["final_no"] for r in members.collect()} == {"p1:s-1": 1, "p1:s-10": 2, "p1:s-11": 3, "p1:s-2": 3}
    evidence = spark.createDataFrame([("b", 1, f"e-{i}", "text", "body", "q", None) for i in (1, 2, 10, 11)], EVIDENCE)
    records, lists = assemble.chapter_evidence(members, evidence)
    assert {r["evidence_id"]: r["evidence_no"] for r in records.collect()} == {"e-1": 1, "e-10": 2, "e-2": 3, "e-11": 4}
    assert {r["final_no"]: r["evidence"] for r in lists.collect()} == {1: [1, 1], 2: [1, 2], 3: [1, 3, 1, 4]}


def test_scores(spark):
    counts = spark.createDataFrame([(0, 0, 0, 0, 0, 0)], ", ".join(f"{c} int" for c in ("excerpts_anchored", "excerpts_total", "statements_grounded", "statements_total", "pages_present", "pages_expected")))
    assert score.rates(counts).select("anchored_rate", "grounded_rate", "complete_rate").first() == (1.0, 1.0, 1.0)
    g = "book_id string, generation struct<model:string,effort:string,max_tokens:int>"
    rows = [("a", ("m", "low", 1)), ("a", ("m", "low", 1)), ("b", ("m", "low", 1)), ("b", None), ("c", None), ("d", (None, None, None)), ("e", ("m", "low", 1)), ("e", ("m", "high", 1))]
    books = score.generation_book(spark.createDataFrame(rows, g))
    assert {r["book_id"]: r["setting"] for r in books.collect()} == {"a": "m|low|1", "b": "mixed", "c": "unknown", "d": "-|-|-", "e": "mixed"}
    assert score.generation_corpus(books).first()["setting"] == "mixed" and score.generation_corpus(books.where("book_id = 'c'")).first()["setting"] == "unknown"
    present = spark.createDataFrame([("m", 1), ("m", 2), ("n", 5)], P)
    marks = spark.createDataFrame([("m", 1, True), ("m", 2, None), ("m", 3, True), ("n", 5, None), ("n", 6, None)], f"{P}, expected_notes boolean")
    none = spark.createDataFrame([], f"{P}, " + ", ".join(f"{c} long" for c in score.COUNTS))
    got = {r["book_id"]: (r["expected_pages"], r["missing_pages"], r["pages_present"]) for r in score.floor_book(none, present, marks).collect()}
    assert got == {"m": ("1,3", "3", 1), "n": ("5", "", 1)}
    good, bad = score.valid_artifacts(spark.createDataFrame([("floor-score", 1), ("floor-score", 2), ("x", 1), (None, None)], "kind string, schema_version int"))
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["kind", "kind", "schema_version"]


def test_cost(spark):
    usage = spark.createDataFrame([("m", 1_000_000, 0, 100, 400, 0), ("x", 1, 1, 0, 0, 0), ("m", None, 1_000_000, None, None, None)], "model string, input_tokens long, output_tokens long, cache_create long, cache_1h long, cache_read long")
    prices = spark.createDataFrame([("m", 3.0, 15.0, 3.75, 6.0, 0.3)], "model string, p_input double, p_output double, p_write_5m double, p_write_1h double, p_read double")
    costs = cost.estimate(usage, prices)
    assert sorted(str(r["cost"]) for r in costs.collect()) == ["15.0", "3.0024", "None"]
    assert cost.run_cost(costs.where("model = 'x'"), ["model"]).first()[1:] == (None, 0, 1)


def test_locators(spark):
    pages = spark.createDataFrame([("b", 0, "i"), ("b", 3, " 2 "), ("b", 9, "2"), ("b", 4, None)], f"{P}, page_label string")
    asked = spark.createDataFrame([("b", "p.2"), ("b", "P2"), ("b", "77"), ("b", "")], "book_id string, folio string")
    assert {r["folio"]: (r["page_indices"], r["matched"]) for r in locate.printed(asked, locate.label_index(pages)).collect()} == {"p.2": ([3, 9], True), "P2": ([3, 9], True), "77": ([], False), "": ([], False)}
    spec = spark.createDataFrame([("a", "x,5", 10)], "spec_id string, spec string, max_page long")
    assert [r["page_index"] for r in locate.lenient_spec(spec).collect()] == [4]
    with pytest.raises(Exception, match="not a page"):
        locate.strict_spec(spec).collect()
    ordered = spark.createDataFrame([("a", "3, 2-4,99", 10)], "spec_id string, spec string, max_page long")
    assert [r["page"] for r in locate.strict_spec(ordered).orderBy("place").collect()] == [3, 2, 4]


def test_passages_equal_nested_loop(spark):
    r = random.Random(2)
    word = lambda: r.choice("alpha beta gamma delta eps".split())
    hay = [("b", i, " ".join(word() for _ in range(r.randint(0, 25)))) for i in range(60)]
    cut = lambda t: t[r.randint(0, max(0, len(t) // 2)) :][: r.randint(0, 60)]
    asked = [(i, cut(r.choice(hay)[2]) if i % 3 else " Start " + r.choice(hay)[2].upper() + " end") for i in range(60)] + [(99, "  "), (98, "a")]
    norm = lambda t: " ".join(t.split()).lower()
    want = {(i, b, p) for i, q in asked for b, p, h in hay if norm(q) and norm(h) and (norm(q) in norm(h) or norm(h) in norm(q))}
    got = locate.passages(spark.createDataFrame(asked, "passage_id long, text string"), spark.createDataFrame(hay, f"{P}, excerpt string"))
    assert {tuple(x) for x in got.collect()} == want


def test_terms_share_slugs_and_substrings(spark):
    labels = spark.createDataFrame([("b", 1, 1, "Art"), ("b", 2, 1, "arts"), ("b", 2, 2, "a-b"), ("b", 2, 3, "a b")], "book_id string, chapter_no long, place int, label string")
    store = terms.term_store(labels)
    assert [(r["term_id"], r["label"], r["n_chapters"]) for r in store.orderBy("place").collect()] == [("t-art", "Art", 2), ("t-a-b", "a b", 1)]
    statements = spark.createDataFrame([("b", 0, "s-1", "A party of two")], f"{P}, statement_id string, text string")
    assert [r["term_id"] for r in terms.link_terms(statements, store).collect()] == ["t-art"]


def test_lines_by_anchor(spark):
    words = spark.createDataFrame([("b", 0, i, t, float(i), i + 1.0, top, top + 1, 10.0) for i, (t, top) in enumerate([("a", 0.0), ("b", 2.0), ("c", 4.0), ("d", 6.5), ("e", 10.0)])], f"{P}, word_no long, text string, x0 double, x1 double, top double, bottom double, size double")
    rows = layout.lines(layout.lined(words)).orderBy("line_no").collect()
    assert [(r["line_top"], r["line_text"]) for r in rows] == [(0.0, "a b"), (4.0, "c d"), (10.0, "e")]


def test_words_split_on_gaps(spark):
    words = spark.createDataFrame([("b", 0, 0, "andso", 0.0, 50.0, 0.0, 10.0, 10.0), ("b", 0, 1, "x", 60.0, 65.0, 0.0, 10.0, 10.0)], f"{P}, word_no long, text string, x0 double, x1 double, top double, bottom double, size double")
    chars = spark.createDataFrame([("b", 0, c, float(x), x + 8.0, 0.0, 10.0) for c, x in zip("andso", (0, 8, 16, 27, 35))], f"{P}, text string, x0 double, x1 double, top double, size double")
    assert [r["text"] for r in layout.split_words(words, chars).orderBy("word_no", "part").collect()] == ["and", "so", "x"]


def test_glyphs_dehyphens_and_tables(spark):
    sign = [(0.0, 0.0), (3.0, 5.0), (10.0, 2.0)]
    points = [("b", 0, 1, x, y) for x, y in sign] + [("b", 0, 2, 7 + 2 * x, 9 + 2 * y) for x, y in sign] + [("b", 0, 3, 1.0, 1.0)]
    ids = {r["gap_no"]: r["glyph_id"] for r in layout.glyph_ids(spark.createDataFrame(points, f"{P}, gap_no long, x double, y double")).collect()}
    assert ids[1] == ids[2] != ids[3]
    lines = spark.createDataFrame([("b", 0, i, t) for i, t in enumerate(["half-", "siblings", "sons-", "4.5.1", "a-", "b-", "c"])], f"{P}, line_no int, line string")
    assert [r["line"] for r in layout.dehyphenated(lines, ["book_id", "page_index"]).orderBy("line_no").collect()] == ["half-siblings", "sons-", "4.5.1", "a-b-c"]
    cells = spark.createDataFrame([("b", 0, 0, 0, 0, "a\nb"), ("b", 0, 0, 0, 1, None), ("b", 0, 0, 1, 0, "c"), ("b", 0, 1, 0, 0, "d")], f"{P}, table_no int, row_no int, cell_no int, cell string")
    assert layout.table_texts(cells).first()["text"] == "a b | \nc\n\nd"
    row = spark.createDataFrame([("x\n 3. \ny", "3"), ("3", None)], "t string, l string")
    assert [r[0] for r in row.select(layout.without_label_lines(F.col("t"), F.col("l"))).collect()] == ["x\ny", "3"]


def test_stream_text_with_signs_and_footnotes(spark):
    schema = f"{P}, word_no long, text string, x0 double, x1 double, top double, bottom double, size double, fontname string, column_no int"
    rows = [("b", 0, 0, "NTr", 0.0, 20.0, 10.0, 20.0, 10.0, "X+Transliteration", 0), ("b", 0, 1, "is", 30.0, 40.0, 10.0, 20.0, 10.0, "T", 0), ("b", 0, 2, "13", 40.0, 44.0, 10.0, 20.0, 5.0, "T", 0), ("b", 0, 3, "note", 0.0, 20.0, 90.0, 95.0, 7.0, "T", 0), ("b", 0, 4, "right", 300.0, 330.0, 10.0, 20.0, 10.0, "T", 1)]
    words = spark.createDataFrame(rows, schema)
    tops = spark.createDataFrame([("b", 0, 0, 90.0), ("b", 0, 1, 100.0)], f"{P}, column_no int, fn_top double")
    heads = spark.createDataFrame([("b", 0, 0.0)], f"{P}, header_bottom double")
    glyphs = spark.createDataFrame([("b", 0, 1, "abcd1234")], f"{P}, gap_no long, glyph_id string")
    got = layout.stream_texts(words, tops, heads, glyphs).first()
    assert got["body"] == "Nṯr ⟨glyph-abcd1234⟩ is[^13]\n\nright" and got["footnotes"] == "note"


def test_proposals(spark):
    def extractor(page):
        if page["page_index"] == 1:
            raise ValueError("no answer")
        return {"terms": [{"label": "A b"}, {"label": " "}], "statements": [{"key": "k1", "text": " one ", "terms": ["A-B", "A b"], "evidence": [{"excerpt": "q"}]}, {"type": "method", "basis": "reported", "text": "two", "evidence": [{"excerpt": "r", "source": "footnote", "script": "latin"}]}], "relations": [{"from": "k1", "to": "A b", "type": "defines"}, {"from": "k1", "to": "s-2", "type": "supports"}, {"from": "k1", "to": "nowhere", "type": "supports"}, {"from": "k1", "to": "s-2"}]}

    made = propose.propose(spark.createDataFrame([("b", 0, "x"), ("b", 1, "y")], f"{P}, text string"), extractor, 2)
    assert {r["page_index"]: (r["status"], r["error"]) for r in made.collect()} == {0: ("ok", None), 1: ("failed", "ValueError: no answer")}
    p = propose.parsed(made)
    s = propose.canonical_statements(p)
    assert [(r["statement_id"], r["type"], r["basis"], r["text"]) for r in s.orderBy("n").collect()] == [("s-1", "claim", None, "one"), ("s-2", "method", "reported", "two")]
    assert [(r["evidence_id"], r["source"], r["script"]) for r in propose.canonical_evidence(s).orderBy("evidence_id").collect()] == [("e-1", "body", None), ("e-2", "footnote", None)]
    t = propose.canonical_terms(p, s)
    assert [(r["term_id"], r["label"]) for r in t.orderBy("place").collect()] == [("t-a-b", "A b"), ("t-a-b-1", "A-B")]
    assert sorted((r["src"], r["dst"]) for r in propose.canonical_relations(p, s, t).collect()) == [("s-1", "s-2"), ("s-1", "t-a-b")]


def test_languages(spark):
    rows = spark.createDataFrame([("a", "EN "), ("a", "en"), ("a", None), ("b", None), ("c", "en"), ("c", "fr"), ("d", "de")], "book_id string, language string")
    rolled = propose.roll_up_language(rows)
    assert {r["book_id"]: r["language"] for r in rolled.collect()} == {"a": "en", "b": "unknown", "c": "mixed", "d": "de"}
    decided = spark.createDataFrame([("d", True)], "book_id string, translate boolean")
    assert {r["book_id"]: r["reading"] for r in propose.translation_decision(rolled, "en", decided=decided).collect()} == {"a": "native", "b": "native", "c": "native", "d": "en"}
    assert {r["book_id"]: r["reading"] for r in propose.translation_decision(rolled, "en", explicit=True).collect()} == {"a": "native", "b": "en", "c": "en", "d": "en"}


def test_unreadable_notes_are_no_pages(spark):
    raw = spark.createDataFrame([("b", 0, '{"statements": [{"id": "s-1", "text": "x"}]}'), ("b", 1, "[1]"), ("b", 2, "{oops"), ("b", 3, "")], f"{P}, raw string")
    rows = notes.parsed_notes(raw)
    assert {r["page_index"]: r["readable"] for r in rows.collect()} == {0: True, 1: False, 2: False, 3: False}
    flat = notes.flattened(rows)
    assert flat["statements"].count() == 1 and flat["evidence"].count() == 0


def test_slugs_fold_accents(spark):
    labels = spark.createDataFrame([("b", 1, 1, "ḥm.t"), ("b", 1, 2, "Café  Noir"), ("b", 2, 1, "漢字")], "book_id string, chapter_no long, place int, label string")
    assert {r["term_id"] for r in terms.term_store(labels).collect()} == {"t-hm-t", "t-cafe-noir"}


def test_nested_notes_keep_terms_and_optional_fields(spark):
    from marginalia.sources import notes

    evidence = spark.createDataFrame([("b", 0, 1, "e-1", "text", "q", "footnote", "7", None, 3), ("b", 0, 2, "e-2", "figure", "", "body", None, "cap", None)], f"{P}, pos int, evidence_id string, kind string, excerpt string, source string, locator string, caption string, page_override long")
    statements = spark.createDataFrame([("b", 0, 1, "s-1", "claim", "author", "x", ["e-1", "e-2"])], f"{P}, pos int, statement_id string, type string, basis string, text string, refs array<string>")
    relations = spark.createDataFrame([("b", 0, 1, "s-1", "t-a", "defines")], f"{P}, pos int, src string, dst string, rel_type string")
    named = spark.createDataFrame([("b", 0, 2, "t-b", "B"), ("b", 0, 1, "t-a", "A")], f"{P}, pos int, term_id string, label string")
    used = spark.createDataFrame([("b", 0, "s-1", 1, "t-b"), ("b", 0, "s-1", 0, "t-a")], f"{P}, statement_id string, pos int, term_id string")
    (row,) = notes.nested(evidence, statements, relations, "pos", named, used).collect()
    assert '"caption":"cap"' in row["notes"] and '"basis"' not in row["notes"]
    flat = notes.flattened(notes.parsed_notes(spark.createDataFrame([("b", 0, row["notes"])], f"{P}, raw string")))
    got = {r["evidence_id"]: (r["locator"], r["caption"], r["page_override"]) for r in flat["evidence"].collect()}
    assert got == {"e-1": ("7", None, 3), "e-2": (None, "cap", None)}
    assert [r["label"] for r in flat["terms"].orderBy("pos").collect()] == ["A", "B"] and [r["term_id"] for r in flat["statement_terms"].orderBy("pos").collect()] == ["t-a", "t-b"]


def test_chapter_relations_in_order_of_first_occurrence(spark):
    from marginalia.operators import assemble

    members = spark.createDataFrame([("b", 1, "p0:s-1", 1), ("b", 1, "p0:s-2", 2), ("b", 1, "p1:s-1", 3)], "book_id string, chapter_no long, key string, final_no int")
    within = spark.createDataFrame([("b", 1, 0, "s-1", "s-1", "supports"), ("b", 0, 5, "s-2", "s-1", "supports"), ("b", 0, 2, "s-1", "s-2", "defines"), ("b", 0, 9, "s-1", "s-2", "defines"), ("b", 0, 1, "s-1", "t-x", "defines")], f"{P}, pos int, src string, dst string, rel_type string")
    across = spark.createDataFrame([("b", 1, "p1:s-1", "p0:s-1", "contrasts"), ("b", 2, "p0:s-2", "p0:s-1", "supports")], "book_id string, place int, src string, dst string, rel_type string")
    got = assemble.chapter_relations(members, within, across).orderBy("rel_no").collect()
    assert [(r["rel_no"], r["src_no"], r["dst_no"], r["rel_type"]) for r in got] == [(1, 1, 2, "defines"), (2, 2, 1, "supports"), (3, 3, 1, "contrasts")]


def test_hot_keys_join_like_others(spark):
    from pyspark.sql import functions as F

    from marginalia.operators.components import join_counted

    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"))
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = join_counted(left, right, "key", "n", 1000, share=100)
    assert sorted(got.columns) == ["id", "key", "least"] and sorted(map(tuple, got.select("id", "least").collect())) == sorted(map(tuple, left.join(right, "key").select("id", "least").collect()))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from marginalia.sources import shared

    class Context:
        master = "spark://host:7077"

        class _Conf:
            def get(self, name):
                return None

        def getConf(self):
            return self._Conf()

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())
