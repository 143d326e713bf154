"""Quoted and free hits of the toxicity score."""

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import toxicity

FREE = [
    "you’re an idiot and that’s it", '"Fine." you idiot! "Bye."', "‘Fine’ you idiot ‘bye’", "«oui» idiot «non»", 'he said "no" to the idiot and left', "an idiot’s word, the dogs’ idiot", '5" idiot 6"', 'idiot', '"', 'so "one idiot and',
    "„ja“ idiot „nein“", 'an idiot" he said', "“a” idiot “b”", 'he said: "one two three four five six seven idiot eight"',
]
QUOTED = ['he said "you idiot" to me', "“you idiot”", '"idiot"', "„du idiot“ sagte er", "«quel idiot»", "»du idiot«", "‘an idiot’s word’", '"don’t, idiot!" she said', "(“idiot”)", 'he said "no", then "idiot".']


@pytest.mark.parametrize("text, quoted", [(t, False) for t in FREE] + [(t, True) for t in QUOTED])
def test_a_hit_is_quoted_where_a_quotation_is_open(text, quoted):
    x = dict(zip(toxicity.FEATURES, toxicity.featured(pa.array([text]), toxicity.Lexicon(["idiot"]), 6)[0]))
    hits = text.count("idiot")
    assert (x["quoted"] > 0, x["free"] > 0) == ((True, False) if quoted else (False, hits > 0))


def test_features_equal_plain_counts():
    """All six features of texts with known hits, put together from the words one by one."""
    lexicon = toxicity.Lexicon(["moron", "idiot", "dunce*"])
    text = 'A moron, a mroon? "An idiot" and idiots; duncelike words here, "moron'
    words = text.split()
    hits = [(0, 0, False), (1, 0, True), (1, 1, False), (2, 0, False), (0, 0, False)]  # term, edits, quoted; m-r-o-o-n needs two
    weight = [0.5**k for _, k, _ in hits]
    free = sum(w for w, h in zip(weight, hits) if not h[2])
    want = [np.log1p(free), np.log1p(1.0), min(1, 20 * free / len(words)), np.log1p(3), np.log1p(1), np.log1p(3)]
    assert np.allclose(toxicity.featured(pa.array([text]), lexicon, 6)[0], want)
