import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, ids string, fp string, spans string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, extra columns whose names clash."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a", 1, "x", "y", "z", "f", "s"),
        (2, None, "en", "a", None, None, None, None, None, None),
        (3, "", None, None, 0, "x", "y", "z", "f", "s"),
        (4, " \n\t  ", "fr", "b", 5, None, None, None, None, None),
        (5, long, "en", "a", len(long), "x", "y", "z", "f", "s"),
        (6, f"before one {passage} after one", "en", "a", 1, "x", "y", "z", "f", "s"),
        (7, f"{passage} tail of seven\nand a line\nand a line", "en", "a", 1, "x", "y", "z", "f", "s"),
        (7, f"{passage} tail of seven\nand a line\nand a line", "en", "a", 1, "x", "y", "z", "f", "s"),
        (8, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a", 1, "x", "y", "z", "f", "s"),
        (None, f"no id {passage}", None, "a", 1, "x", "y", "z", "f", "s"),
        (9, "naïve café ÉCOLE ﬁn 漢字 😀 <|endoftext|> token = 'abcDEF123456' " + "0123456789abcdef" * 3, "fr", "a", 1, "x", "y", "z", "f", "s"),
        (10, "12345 67 !!", "de", "a", 1, "x", "y", "z", "f", "s"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    """The small corpus as (doc_id, text) in order."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r["doc_id"], r["text"]) for r in rows)
