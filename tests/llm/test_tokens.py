"""Ids against the tokenizers library: byte-level and word-level BPE, packing, token store."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marginalia.llm import byte_bpe, forced_bpe, packing, token_store
from marginalia.llm.mph import Mph, fingerprints

PIECES = [" ", "  ", "\n", "\n\n", "\t", "'s", "'re", "'", "a", "bé", "é", "ñ", "漢", " ", "　", "1", "23", ".", "!!", "<|endoftext|>", "\x1c", "\x85", "​", "ß", "\r\n", "A", " ", "é", "😀", "the", "Word", "_", "\x00", "\x7f", "İ", "ǅ", "²", "Σ", "ς", "ﬁ", "Å"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", "word " * 5000]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_byte_bpe_equals_library(byte_library):
    t = texts(4000, 1)
    ids, at = byte_bpe.loaded(*byte_bpe.public()).encode(pa.array(t))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in byte_library.encode_batch(t, add_special_tokens=False)]


def test_forced_bpe_equals_library():
    t, model = texts(4000, 2), forced_bpe.loaded(forced_bpe.public())
    library = Tokenizer.from_file(forced_bpe.public())
    for (ids, decoded), e in zip(model.slice(pa.array(t)), library.encode_batch(t, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids
        assert decoded.decode() == library.decode(e.ids, skip_special_tokens=False) == model.decode(ids).decode()


def test_forced_cuts_are_never_inside_a_token():
    model = forced_bpe.loaded(forced_bpe.public())
    for token in list(model.whole.get_vocab(with_added_tokens=False))[::97]:
        b = [model.byte_of[c] for c in token.removesuffix("</w>")]
        assert model.joined[b[:-1], b[1:]].all()


def test_op3_edges(edge, empty):
    got = forced_bpe.digested(edge).collect()
    assert len(got) == 12 and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert forced_bpe.digested(empty).count() == 0
    assert forced_bpe.encoded(edge).count() == 12


def packed(rows, ids):
    """Checks that pieces tile the documents and sequences; returns the padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, parts in by_doc.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == len(ids[d])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
    return padding


def test_op7_packs_everything_once(spark, sf, docs, byte_library):
    ids = {d: np.array(e.ids + [0], "<u4") for (d, _), e in zip(docs, byte_library.encode_batch([t or "" for _, t in docs], add_special_tokens=False))}
    rows = packing.op7_packing(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    assert packed(rows, ids) < 0.06 * sum(map(len, ids.values()))


def test_op7_holds_ids(spark, sf, docs, byte_library):
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).where("doc_id = 5").orderBy("start").collect()
    got = np.concatenate([np.frombuffer(r["ids"], "<u2") for r in rows])
    assert got.tolist() == byte_library.encode(dict(docs)[5], add_special_tokens=False).ids + [0]


def test_op7_edges(edge, empty):
    rows = packing.pack(edge).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (2, 3)) == 2
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 7)
    assert packing.pack(empty).count() == 0


def test_windows_stay_bounded():
    w = packing.Windows(64, 4, 4, 0)
    r = random.Random(3)
    for i in range(500):
        ids = np.arange(r.randint(1, 150), dtype="<u4")
        w.add(i, ids, ids)
        assert len(w.room) <= 4
    assert w.done


def test_mph_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    mph = Mph.build(keys)
    assert sorted(mph.slots(keys)) == list(range(len(keys)))
    again, used = Mph.load(mph.dump() + b"rest")
    assert used == len(mph.dump()) and (again.slots(keys) == mph.slots(keys)).all()
    others = np.random.default_rng(2).integers(0, 2**63, 1000, dtype=np.uint64)
    slot = mph.slots(others)
    held = np.zeros(mph.total, np.uint32)
    held[mph.slots(keys)] = fingerprints(keys)
    assert ((slot < 0) | (held[slot] != fingerprints(others))).mean() > 0.99


def test_op8_reads_back(spark, sf, docs, byte_library):
    got = {r["doc_id"]: r for r in token_store.op8_token_store(spark, sf).collect()}
    at = 0
    for (d, _), e in zip(docs, byte_library.encode_batch([t or "" for _, t in docs], add_special_tokens=False)):
        ids = np.array(e.ids + [2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert len(got) == len(docs)


def test_op8_edges_and_misses(spark, edge, empty):
    made = token_store.store(edge, partitions=3)
    rows = made.get(edge.select("doc_id")).collect()
    assert len(rows) == 12 and sum(r["doc_id"] is None for r in rows) == 1 and sum(r["doc_id"] == 7 for r in rows) == 2
    spans = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert made.get(spark.createDataFrame([(77,), (5,)], "doc_id long")).count() == 1
    assert token_store.store(empty, partitions=2).get(edge.select("doc_id")).count() == 0


def test_a_retried_task_finds_its_file_there(tmp_path):
    fs = token_store.pafs.LocalFileSystem()

    class Strict:
        """A store in which a move never replaces a file."""

        def __getattr__(self, name):
            return getattr(fs, name)

        def move(self, a, b):
            if fs.get_file_info(b).type == token_store.pafs.FileType.File:
                raise OSError("there is such a file")
            fs.move(a, b)

    name = str(tmp_path / "ids.bin")
    for content in (b"abc", b"abc", b"longer"):
        part = str(tmp_path / ".part")
        with open(part, "wb") as out:
            out.write(content)
        token_store._settle(Strict(), part, name)
        assert open(name, "rb").read() == content and [p.name for p in tmp_path.iterdir()] == ["ids.bin"]


def test_store_written_twice_to_one_folder_reads_the_same(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    got = [sorted(map(tuple, token_store.store(docs, f"file://{tmp_path}/s", partitions=4).get(docs.select("doc_id")).collect())) for _ in range(2)]
    assert got[0] == got[1] and len(got[0]) == 40
