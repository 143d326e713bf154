"""Language ID: sizes against brute force, rejection on real rows, letters, bounds and whole texts."""

import collections
import re

import numpy as np
import zstandard as z
from pyspark.sql import functions as F

from marginalia.llm import language_id

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\W\d_]+")


def brute_force(text, contents):
    """Language and margin of a text, one block and dictionary at a time."""
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    raw, total = text.lower().encode(), {}
    for lang, words in contents.items():
        how = z.ZstdCompressionParameters.from_level(6, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        c = z.ZstdCompressor(compression_params=how, dict_data=z.ZstdCompressionDict(words, dict_type=z.DICT_TYPE_RAWCONTENT))
        total[lang] = sum(len(c.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))
    ranked = sorted(total.values())
    return min(total, key=total.get), (ranked[1] - ranked[0]) / ranked[1]


def test_predictions_equal_brute_force_over_whole_texts(spark, sf, docs):
    train = spark.read.parquet(f"{sf}/documents.parquet").where(language_id.id_hash_mod(4) != 2)
    want = collections.defaultdict(collections.Counter)
    often = collections.Counter()
    for r in train.where("lang is not null").collect():  # fewer than 200 a language, so all are in the sample
        want[r["lang"]].update(set(WORD.findall((r["text"] or "").lower())))
        often[r["lang"]] += 1
    contents = {lang: " ".join(w for _, w in sorted((n, w) for w, n in want[lang].items())).encode() for lang in sorted(want, key=lambda x: (-often[x], x))}
    assert max(often.values()) <= 200 and language_id.dictionaries(train) == contents
    got = {r["doc_id"]: r for r in language_id.op2_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        lang, margin = brute_force(t or "", contents)
        assert got[d]["lang_pred"] == lang and abs(got[d]["margin"] - margin) < 1e-12 and got[d]["rejected"] == (lang == "und" or margin < 0.03)


def test_rejects_mixed_and_foreign_texts_and_keeps_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and length(text) > 600").orderBy("doc_id")
    model = language_id.Compressed(language_id.dictionaries(docs.where(language_id.id_hash_mod(4) != 2)))
    by = collections.defaultdict(list)
    for r in docs.where(language_id.id_hash_mod(4) == 2).select("text", "lang").collect():
        by[r["lang"]].append(r["text"][:600])
    langs = sorted(by)
    n = min(len(by[lang]) for lang in langs)
    mixed = [by[a][i] + "\n" + by[b][i] for k, a in enumerate(langs) for b in langs[k + 1 :] for i in range(n)]
    margins = np.array([model.predict(t)[1] for t in mixed])
    assert len(margins) > 50 and (margins < language_id.LEAST_MARGIN).mean() > 0.3
    own = np.array([model.predict(t)[1] for lang in langs for t in by[lang]])
    assert (own < language_id.LEAST_MARGIN).mean() < 0.02
    foreign = ["съешь ещё этих мягких французских булок да выпей чаю " * 9, "天地玄黃宇宙洪荒日月盈昃辰宿列張" * 20, "zqxj vkpw qqzx jwvk xzqp wvkj pqzx " * 9, "hvǫrr maðr skyldi þǫgull ok hugalr þjóðans barn " * 9]
    assert all(model.predict(t)[1] < language_id.LEAST_MARGIN for t in foreign), [model.predict(t) for t in foreign]


def test_number_signs_are_no_letters():
    model = language_id.Compressed({"a": b"alpha beta gamma delta", "b": b"uno dos tres cuatro"})
    for text in ("²½", "Ⅷ ⅷ", "12 34", "①②", "", "_-_"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("12 α")[0] != "und"


def test_short_texts_are_judged_by_their_margin_alone():
    model = language_id.Compressed({"a": b"alpha beta gamma delta epsilon", "b": b"uno dos tres cuatro cinco"})
    assert model.predict("gamma delta epsilon")[1] >= language_id.LEAST_MARGIN > model.predict("x")[1]


def test_words_anywhere_in_a_text_count(spark):
    rows = [(1, "x " * 30_000 + "lateword", "en"), (2, "bonjour", "fr")]
    contents = language_id.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert b"lateword" in contents["en"]


def test_rows_of_one_id_are_bounded_and_told_apart(spark):
    rows = spark.range(3000).select(F.lit(5).alias("doc_id"), F.concat(F.lit("word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang"))
    contents = language_id.dictionaries(rows, sample_docs=200)
    assert len(contents["en"].split()) == 200
