"""Common words against brute force over all documents."""

import collections

from marginalia.llm import quality


def test_common_words_count_all_documents_and_long_words(spark):
    long = "स्वतंत्रता"  # 30 bytes
    rows = [(i, f"{long} The w{i % 7} w{i % 7} only{i}", "hi") for i in range(500)] + [(900 + i, f"der w{i % 3}", "de") for i in range(9)] + [(None, "der", "de"), (1, None, "de"), (2, "x", None)]
    want = {}
    for _, t, lang in rows:
        if lang:
            want.setdefault(lang, collections.Counter()).update(set((t or "").encode().lower().split()))
    top = {lang: [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:20]] for lang, c in want.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert quality.common_words(docs, 20) == top and quality.common_words(docs, 20, most_held=5) == top
    assert long.encode() in top["hi"]


def test_rare_words_of_a_sample_do_not_count(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    many = docs.unionByName(docs.selectExpr("doc_id + 100000 as doc_id", "concat('everywhere ', text) as text", "lang", "source", "n_chars"))
    for _ in range(3):
        many = many.unionByName(many.selectExpr("doc_id + 200000 as doc_id", "text", "lang", "source", "n_chars"))
    want = {}
    for r in many.select("text", "lang").collect():
        if r["lang"] is not None:
            want.setdefault(r["lang"], collections.Counter()).update(set((r["text"] or "").encode().lower().split()))
    got = quality.common_words(many)
    assert got == {lang: [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:100]] for lang, c in want.items()}
