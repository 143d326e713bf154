"""Text expressions on rows with expected values written by hand."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T


def value(spark, expression, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("t"))).collect()]


def test_normalized(spark):
    given = ["a b c\u001cd", " item", "‘x’ “y” – — …", "Robins1 and Egypt10, (1993)", "P. BM 1 and 1.1", "a123", "see[^13] it", "[^[^1]2]", "", "  \n ", None, "end7"]
    want = ["a b c d", "item", "'x' \"y\" - - ...", "Robins and Egypt, (1993)", "P. BM 1 and 1.1", "a123", "see it", "[^2]", "", "", "", "end"]
    assert value(spark, T.normalized, *given) == want


def test_empty_quote_is_anchored(spark):
    assert value(spark, lambda t: T.is_anchored(T.normalized(t), F.lit("some text")), "", None, " \t", "some", "other") == [True, True, True, True, False]


def test_transliterated_at_once(spark):
    assert value(spark, T.transliterated, "NTr", "!H", "$nmw", "£x", "@wt-Hr", "plain") == ["Nṯr", "Hḥ", "H̱nmw", "H̱ḫ", "Ḥwt-ḥr", "plꜥin"]
    assert value(spark, lambda t: T.by_font(t, F.lit("CB+Transliteration")), "T") == ["ṯ"]
    assert value(spark, lambda t: T.by_font(t, F.lit("Times")), "T") == ["T"]


def test_labels_and_headers(spark):
    assert value(spark, T.is_page_label, "3", "iv", ".12.", "mild", "civil", "I", "page", "", ".") == [True, True, True, True, True, True, False, False, False]
    assert value(spark, T.looks_like_header, "CHAPTER 1", "ABC", "ABCDe", "ABCde", None) == [True, False, True, False, False]


def test_despaced(spark):
    assert value(spark, T.despaced, "C HAPTER 1: A IMS AND O BJECTIVES", "A GREAT HALL", "TABLE L", "X (cid:3) Y Z", "a b c", None) == ["CHAPTER 1: AIMS AND OBJECTIVES", "AGREAT HALL", "TABLE L", "XY Z", "ab c", ""]


def test_section_keys(spark):
    assert value(spark, T.section_key, "C HAPTER 5: Sisters", "chapter iv", "Chapters 5", "PART ONE") == ["CHAPTER 5", "CHAPTER IV", "CHAPTERS 5", "PART ONE"]
    assert value(spark, T.is_prose, "Table of contents", "TABLE B", "Chapter 1", "Figures", "Tables") == [False, False, True, False, False]


def test_open_ends_and_completions(spark):
    assert value(spark, T.ends_open, "cut in the", "done. ", "quoted”", "note]", "", None) == [True, False, False, False, False, False]
    assert value(spark, T.completion, "  rest of it.[^30] More.", "no end", "e.g. this. That", "x" * 401 + ". y", "said 'so.' Then", None) == ["rest of it.[^30]", "no end", "e.g.", "x" * 400, "said 'so.'", ""]


def test_sentences(spark):
    assert value(spark, T.sentences, "One. Two! (three? Four.", "No split. here") == [["One.", "Two!", "(three?", "Four."], ["No split. here"]]


def test_terms(spark):
    assert value(spark, T.term_key, "Half-Siblings  of Wives", "boxes cities gas glass churches", None) == ["half-sibling of wife", "box city gas glass church", ""]
    assert value(spark, T.ascii_slug, "Half-siblings (x)", "--") == ["t-half-siblings-x", "t-"]


def test_citations(spark):
    text = "It is so [s-1] [s-2], really [s-x9](#note-s-x9).\n\n---\n## Notes & Sources\nmore [s-1]"
    assert value(spark, T.without_citations, text, "Plain ( [s-1] ) text") == ["It is so, really.\n", "Plain text\n"]
    known = F.array(F.lit("s-1"), F.lit("s-3"))
    assert value(spark, lambda t: T.linked_citations(t, known), "a [s-1][s-2] b [s-3, s-4]\n[s-1]", "none") == ["a [s-1](#note-s-1), s-2 b [s-3](#note-s-3), s-4\n[s-1](#note-s-1)", "none"]


def test_footnote_marker(spark):
    assert value(spark, lambda t: T.footnote_marker(t, F.lit(6.0), F.lit(10.0)), "13", ".13", "S 216)", "a1b2", "text") == ["[^13]", ".[^13]", "S [^216])", "a1b2", "text"]
    assert value(spark, lambda t: T.footnote_marker(t, F.lit(9.0), F.lit(10.0)), "1993") == ["1993"]


@pytest.mark.parametrize("given, want", [(("m", "low", 8000), "low@8000"), (("m", "low", None), "low"), (("m", None, 5), "m"), ((None, None, None), "unknown")])
def test_generation_label(spark, given, want):
    row = spark.createDataFrame([(given,)], "g struct<model:string,effort:string,max_tokens:int>")
    assert row.select(T.generation_label(F.col("g"))).first()[0] == want


def test_case_folding_equals_pythons_on_all_code_points(spark):
    rows = [(i, "".join(chr(c) for c in range(i, i + 256) if not 0xD800 <= c < 0xE000 and c != 0)) for i in range(0, 0x1F000, 256)]
    got = spark.createDataFrame(rows, "i long, t string").select("i", T.folded(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: t.casefold() for i, t in rows}
    same = spark.createDataFrame([("Straße  İx",), ("STRASSE i̇X",)], "t string").select(T.normalized_passage(F.col("t")).alias("t")).distinct()
    assert same.count() == 1
