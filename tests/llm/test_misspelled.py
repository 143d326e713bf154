"""Misspellings that the lexicon finds by each term's own length."""

import pyarrow as pa

from marginalia.llm import toxicity


def test_five_letter_terms_with_one_edit_anywhere():
    lexicon = toxicity.Lexicon(["idiot", "clown", "loser", "moron", "trash", "dumb"])
    for w, term in (("idot", 0), ("clwn", 1), ("losr", 2), ("morn", 3), ("trsh", 4), ("diot", 0), ("xidiot", 0), ("idioot", 0)):
        assert lexicon.match(w) == (term, 1), w
    assert lexicon.match("idt") is None and lexicon.match("dub") is None and lexicon.match("xxidiot") is None


def test_inner_digits_and_marks_are_part_of_a_token():
    lexicon = toxicity.Lexicon(["idiot", "trash"])
    assert lexicon.hits("id1ot,") == [(0, 1)] and lexicon.hits("\"TRA5H\"") == [(1, 1)] and lexicon.hits("id-iot") == [(0, 1)]
    assert lexicon.hits("idiot-trash") == [(0, 0), (1, 0)] and lexicon.hits("1234") == []
    x = toxicity.featured(pa.array(["you tra5h", "you track"]), lexicon, 6)
    assert x[0, 0] > 0 and not x[1].any()


def test_words_stay_beside_a_shorter_stem():
    terms = toxicity.chosen_terms([("worthl*", 9, 0), ("worthless", 9, 0), ("worthy", 9, 9)], 5, 0.9)
    assert sorted(terms) == ["worthl*", "worthless"] and toxicity.Lexicon(terms).match("wrhless") == (terms.index("worthless"), 2)


def test_the_whole_lexicon_is_used():
    counts = [(f"term{i}x", 9, 0) for i in range(3000)]
    assert len(toxicity.chosen_terms(counts, 5, 0.9)) == 3000


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.range(3000).selectExpr("5L as doc_id", "translate(cast(id as string), '0123456789', 'abcdefghij') as text")
    labels = spark.createDataFrame([(5, 1)], "doc_id long, toxic int")
    assert len(toxicity.trained(docs, labels, sample_docs=100, least_docs=1).terms) == 100
