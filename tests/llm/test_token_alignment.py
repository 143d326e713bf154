"""Alignment of two tokenizers against a plain computation with the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marginalia.llm import token_alignment as ta
from tests.llm.test_tokens import PIECES


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters():
    """The rule by which a byte-level vocabulary writes bytes as letters."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b) if b in own else chr(next(rest)): b for b in range(256)}


LETTERS = byte_letters()


def tokens(text, libraries):
    """(id, bytes) of A's and B's tokens, or none."""
    if not text:
        return [], []
    a, b = libraries
    of_a = [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    of_b = [(i, bytes([i - 3]) if 3 <= i < 259 else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (of_a, of_b) if b"".join(x for _, x in of_a) == whole == b"".join(x for _, x in of_b) else ([], [])


def plain(texts, libraries):
    """The measures of each text, token by token."""
    out, links, total = [], [], Counter()
    for text in texts:
        of_a, of_b = tokens(text, libraries)
        spans = []
        for side in (of_a, of_b):
            at, own = 0, []
            for i, raw in side:
                own.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(own)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, t in side if lo <= s and t <= e) for side in spans))
            lo = e
        mine = [(i, j) for i, s, t in spans[0] for j, u, v in spans[1] if s < v and u < t]
        links.append(mine)
        total.update(mine)
        out.append([len(of_a), len(of_b), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    most = Counter()
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    return [[*row[:4], sum(total[p] == most[p[1]] for p in mine), sum(total[p] for p in mine), row[4]] for row, mine in zip(out, links)], total


def got(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: [r[c] for c in (*ta.MEASURES, "groups_sha256")] for r in ta.aligned(docs, **more).collect()}
    return [rows[i] for i in range(len(texts))]


def test_equals_plain_computation(spark, libraries):
    r = random.Random(7)
    texts = ["".join(r.choice([*PIECES, " naming", " things", "▁", "  ", "<s>", "<unk>", "<0x41>"]) for _ in range(r.randint(0, 25))) for _ in range(250)]
    texts += [None, "", " ", "a", "▁", "same text"] + ["same text again"] * 40 + ["x" * 700]
    assert got(spark, texts) == plain(texts, libraries)[0]
    assert got(spark, texts, block_bytes=300) == plain(texts, libraries)[0]


def test_whole_small_corpus(spark, sf, libraries):
    from marginalia.llm.registry import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in docs if t is None or len(t) < 1500]
    want, _ = plain([t for _, t in short], libraries)
    rows = {r["doc_id"]: r for r in queries()["op13_token_alignment"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for (i, _), w in zip(short, want):  # counts are of the whole corpus, the rest of each text alone
        assert [rows[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")] == [*w[:4], w[6]]


def test_pair_counts_weigh_copies(spark, libraries):
    texts = ["one text here"] * 9 + ["another text there"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, counts = ta.measured(docs)
    n = libraries[1].get_piece_size()
    assert {divmod(r["pair"], n): r["count"] for r in counts.collect()} == dict(plain(texts, libraries)[1])


def test_varints():
    x = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**21, 2**28 - 1, 5])
    assert ta.from_varints(ta.varints(x)[0]).tolist() == x.tolist()


def test_special_strings_are_plain_text(libraries):
    model = ta.loaded(*ta.public())
    a, _, b, _, _ = model.encode(pa.array(["see <|endoftext|> here <s>"]))
    assert [a.tolist(), b.tolist()] == [[i for i, _ in side] for side in tokens("see <|endoftext|> here <s>", libraries)]


def test_edges(spark, edge, empty):
    rows = ta.aligned(edge).collect()
    assert len(rows) == 12 and {tuple(r[c] for c in (*ta.MEASURES, "groups_sha256")) for r in rows if r["doc_id"] in (2, 3)} == {(0, 0, 0, 0, 0, 0, "")}
    assert ta.aligned(empty).count() == 0
