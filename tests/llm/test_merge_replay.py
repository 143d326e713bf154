"""Merge replay against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from marginalia.llm import merge_replay
from tests.llm.test_tokens import PIECES

MORE = ["aaaaaaaa", "abab", "你好世界", "مرحبا", "हिन्दी", "don't", "x" * 300, "=-" * 90, " ", "ℵ", "٣"]


@pytest.fixture(scope="module")
def library():
    rows = map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in rows}, special_tokens={})


def equal(texts, library):
    model = merge_replay.loaded(*merge_replay.public())
    ids, at = model.encode(pa.array(texts, pa.string()))
    out, to = model.decode(ids, at)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t or ""), t
        assert out[to[i] : to[i + 1]].tobytes() == (t or "").encode()


def test_equals_library_on_mixed_texts(library):
    r = random.Random(3)
    equal(["".join(r.choice(PIECES + MORE) for _ in range(r.randint(0, 30))) for _ in range(4000)] + [None, "", "a" * 5000, "ab" * 2000], library)


def test_equals_library_on_any_characters(library):
    r = random.Random(4)
    blocks = [lambda: r.randint(1, 0x2FF), lambda: r.randint(0x300, 0x33FF), lambda: r.randint(0x4E00, 0x9FFF), lambda: r.randint(97, 122), lambda: r.randint(97, 122)]
    equal(["".join(chr(r.choice(blocks)()) for _ in range(r.randint(1, 60))) for _ in range(3000)], library)
    equal([f" a{chr(c)}b 1{chr(c)}2 .{chr(c)}!" for c in range(0x3400) if not 0xD800 <= c < 0xE000], library)


def test_one_slice_or_many_give_equal_ids(library, docs):
    equal([t for _, t in docs], library)
    model = merge_replay.loaded(*merge_replay.public())
    texts = pa.array([t for _, t in docs], pa.string())
    whole, _ = model.encode(texts)
    assert np.array_equal(whole, np.concatenate([model.encode(texts[i : i + 17])[0] for i in range(0, len(texts), 17)]))


def test_a_lesser_rank_that_a_merge_makes_possible_goes_first():
    """b+c has rank 6, and what it gives makes abc, of rank 5, possible: the order has to step back."""
    tokens = [b"a", b"b", b"c", b"d", b"e", b"abc", b"bc", b"abcbc"]
    model = object.__new__(merge_replay.MergeReplay)
    model.rank = {t: i for i, t in enumerate(tokens)}
    model.n = len(tokens)
    found = sorted((model.rank[t[:i]] * model.n + model.rank[t[i:]], r) for t, r in model.rank.items() for i in range(1, len(t)) if t[:i] in model.rank and t[i:] in model.rank)
    model.pair, model.gives = (np.array(x, np.int64) for x in zip(*found))
    model.early = np.zeros(model.n, bool)
    for half in (model.pair // model.n, model.pair % model.n):
        model.early[half[model.gives < half]] = True
    model.single = np.zeros(256, np.int64)
    model.single[[97, 98, 99, 100, 101]] = range(5)
    assert model.early[6] and not model.early[5]
    library = tiktoken.Encoding("small", pat_str=".+", mergeable_ranks=model.rank | {bytes([i]): 300 + i for i in range(256) if bytes([i]) not in model.rank}, special_tokens={})
    r = random.Random(1)
    for word in ["".join(r.choice("abcde") for _ in range(r.randint(1, 14))) for _ in range(500)]:
        if word.encode() in model.rank:
            continue
        ids, count = model.replay(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
        assert ids.tolist() == library.encode_ordinary(word) and count.tolist() == [len(ids)]


def test_edges(spark, edge, empty):
    got = merge_replay.digested(edge).collect()
    assert len(got) == 12 and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert {r["decoded_sha256"] for r in got if r["doc_id"] in (2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert merge_replay.digested(empty).count() == 0
    back = {r["doc_id"]: r["bytes"] for r in merge_replay.decoded(merge_replay.encoded(edge)).collect()}
    assert all(bytes(back[r["doc_id"]]) == (r["text"] or "").encode() for r in edge.collect())
