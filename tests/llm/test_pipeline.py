"""The pipeline's stages on the small corpus, against brute-force versions of what each decides."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm import language_id, secrets
from tests.llm.test_duplicates import expected_removal
from tests.llm.test_language import brute_force
from tests.llm.test_near_copies import kept_ids

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_keep_columns_and_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stage("language_id")(spark, docs, SF)
    contents = language_id.dictionaries(docs.where(language_id.id_hash_mod(4) != 2))
    sure = [r["doc_id"] for r in docs.collect() if brute_force(r["text"] or "", contents)[1] >= 0.03]  # the rest: a few short or shouted texts
    assert kept.columns == COLUMNS and sorted(r["doc_id"] for r in kept.collect()) == sorted(sure) and len(sure) > 190

    one = stage("near_dedup")(spark, docs, SF)
    assert one.columns == COLUMNS and sorted(r["doc_id"] for r in one.collect()) == kept_ids([(r["doc_id"], r["text"]) for r in docs.collect()])

    cut = stage("substring_dedup")(spark, docs, SF).collect()
    want = {d: n - g for d, n, g, _ in expected_removal([(r["doc_id"], r["text"]) for r in docs.collect()], 50)}
    assert {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in cut} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut)

    clean = stage("secrets")(spark, docs, SF)
    assert clean.columns == COLUMNS and clean.count() == docs.count()
    assert not any(re.search(r"(?i)token = \"[0-9a-f]{40}\"", r["text"]) for r in clean.collect())


def test_run_equals_brute_force(spark):
    """Every stage in plain Python on all that the one before kept; dictionaries and network are made as the stages make them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.Compressed(language_id.dictionaries(docs.where(language_id.id_hash_mod(4) != 2)))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if t and (got := model.predict(t))[0] != "und" and got[1] >= language_id.LEAST_MARGIN]
    stay = set(kept_ids(rows))
    rows = sorted((d, t) for d, t in rows if d in stay)
    first, cut = {}, []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d:
                gone[i : i + 50] = [True] * 50
        cut.append((d, " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t))
    net = secrets.trained(spark.createDataFrame(cut, "doc_id long, text string"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in cut:
        (raw, spans), = secrets.spans_of(pa.array([t]), net)
        out, at = b"", 0
        for s in spans:
            out += raw[at : s.start] + b"[SECRET]" if s.start >= at else b""
            at = max(at, s.end)
        want[d] = [*tokenizer.encode((out + raw[at:]).decode(), add_special_tokens=False).ids, 0]
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u2").tolist()))
    assert {d: [i for _, part in sorted(p) for i in part] for d, p in pieces.items()} == want


def test_stages_on_edges(spark, edge, empty):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).count() == 0
        out = f(spark, edge, SF)
        if name != "packing":
            assert out.columns == edge.columns
        assert out.count() > 0
    assert stage("near_dedup")(spark, edge, SF).where("doc_id = 7").count() <= 1


def test_stages_pass_clashing_columns_on(spark):
    names = ["kept_id", "_text", "_bucket", "of", "row", "node", "key", "part", "spans", "lang", "ids"]
    rows = [(1, "The words of one text " * 20, *names), (1, "unlike words of the same id " * 20, *names), (None, None, *[None] * len(names)), (2, "The words of one text " * 20, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns and all(r["_bucket"] in (None, "_bucket") for r in out.collect()), name
