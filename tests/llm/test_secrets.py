"""The network of the secret scan: kinds that no base pattern covers, clean texts, windows, and the query as a whole."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import secrets

SF = "/root/testdata/sf0.01"
WORD = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def net(spark):
    return secrets.trained(spark.read.parquet(f"{SF}/documents.parquet"))


def some(r, n, alphabet=WORD):
    return "".join(r.choices(alphabet, k=n))


#: Known kinds of keys; none of them is made up by the training, and no base pattern finds them.
KEYS = {
    "forge": lambda r: ("see ", "ghp_" + some(r, 36)),
    "signed": lambda r: ("Authorization: Bearer ", "eyJhbGciOiJIUzI1NiJ9." + some(r, 60, WORD + "-_") + "." + some(r, 43, WORD + "-_")),
    "cloud": lambda r: ("aws_secret_access_key = ", some(r, 40, WORD + "/+")),
    "chat": lambda r: ("hook ", f"xoxb-{some(r, 12, string.digits)}-{some(r, 12, string.digits)}-" + some(r, 24)),
    "maps": lambda r: ("maps ", "AIza" + some(r, 35, WORD + "-_")),
    "pay": lambda r: ("pay ", "sk_live_" + some(r, 24)),
    "password": lambda r: ("pwd: ", r.choice(("hunter", "dragon", "monkey", "summer")) + some(r, 3, string.digits) + "x"),
}


def test_finds_kinds_that_no_base_pattern_covers_and_leaves_clean_texts(spark, net):
    r = random.Random(8)
    texts = [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if x["text"] and len(x["text"]) > 500]
    hits, falses = {}, []
    for n, (kind, make) in enumerate(KEYS.items()):
        for text in texts[40 * n : 40 * n + 40]:
            before, key = make(r)
            at = text.index(" ", 200)
            planted = f"{text[:at]} {before}{key}{text[at:]}"
            (raw, spans), = secrets.spans_of(pa.array([planted]), net)
            mine = range(len(planted[:at].encode()), len(f"{planted[:at]} {before}{key}".encode()))
            net_spans = [s for s in spans if s.kind == 3]
            assert not any(s.kind != 3 and s.start in mine for s in spans)
            hits.setdefault(kind, []).append(any(s.start in mine for s in net_spans))
            base = [s for s in spans if s.kind != 3]
            falses += [raw[s.start : s.end] for s in net_spans if s.start not in mine and not any(b.start < s.end and s.start < b.end for b in base)]
    recall = {kind: np.mean(h) for kind, h in hits.items()}
    found = sum(sum(h) for h in hits.values())
    assert min(recall.values()) >= 0.9, recall
    assert found / (found + len(falses)) >= 0.95, falses


#: No secrets. The first five are kinds that the training makes up too, the others it does not.
PLAIN = {
    "header": lambda r: r.choice(("Content-Type", "X-Forwarded-For", "Accept-Encoding", "Cache-Control")),
    "uuid": lambda r: "-".join(some(r, n, "0123456789abcdef") for n in (8, 4, 4, 4, 12)),
    "doi": lambda r: f"10.1000/{some(r, 3, string.ascii_lowercase)}{some(r, 3, string.digits)}",
    "stamp": lambda r: f"2024{r.randint(10, 12)}{r.randint(10, 28)}T12{some(r, 2, '012345')}00Z-rc{r.randint(1, 9)}",
    "letters": lambda r: r.choice("ABXz") * r.randint(12, 30),
    "orcid": lambda r: f"0000-000{some(r, 1, '1235')}-{some(r, 4, string.digits)}-{some(r, 3, string.digits)}X",
    "phone": lambda r: f"+49-30-{some(r, 4, string.digits)}-{some(r, 4, string.digits)}",
    "patent": lambda r: f"US{some(r, 8, string.digits)}B2",
    "iban": lambda r: f"DE{some(r, 20, string.digits)}",
    "chemical": lambda r: f"{some(r, 5, string.digits)}-{some(r, 2, string.digits)}-{some(r, 1, string.digits)}",
    "place": lambda r: f"{r.randint(10, 89)}.{some(r, 6, string.digits)}+{r.randint(100, 179)}.{some(r, 6, string.digits)}",
    "path": lambda r: f"/usr/share/{r.choice(('doc', 'lib', 'man'))}/{r.choice(('python3', 'perl5', 'gcc'))}.{some(r, 2, string.digits)}/README",
}


def test_identifiers_stamps_and_numbers_are_no_secrets(spark, net):
    r = random.Random(12)
    texts = [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if x["text"] and len(x["text"]) > 500]
    wrong = {}
    for n, (kind, make) in enumerate(PLAIN.items()):
        for text in texts[30 * n : 30 * n + 30]:
            at = text.index(" ", 200)
            planted = f"{text[:at]} {make(r)}{text[at:]}"
            (_, spans), = secrets.spans_of(pa.array([planted]), net)
            start = len(planted[:at].encode()) + 1
            wrong.setdefault(kind, []).append(any(s.kind == 3 and s.start == start for s in spans))
    assert np.mean([x for w in wrong.values() for x in w]) <= 0.05 and max(map(np.mean, wrong.values())) <= 0.2, {k: np.mean(w) for k, w in wrong.items()}


def test_hashes_named_as_such_and_the_name_before_a_secret():
    found = secrets.Scanned(pa.array(["password: hunter2xyz", 'client_secret = "abcdefgh12"']))
    got = dict(zip([found.raw[a:b] for a, b in zip(found.start.tolist(), found.end.tolist())], found.covered().tolist()))
    assert got == {b"password": False, b"hunter2xyz": True, b"client_secret": False, b"abcdefgh12": True}


def test_spans_of_the_query_come_from_the_network_too(spark):
    rows = secrets.op5_secrets(spark, SF).collect()
    assert sum(r["n_net"] for r in rows) > 0 and all(r["spans"].count("net:") == r["n_net"] for r in rows)
    assert np.mean([r["n_net"] > r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows]) < 0.01


def test_a_secret_of_any_length_is_read_to_its_end(net):
    r = random.Random(3)
    text = "plain words before " + "word" * 100 + some(r, 60) + " and after"  # joined on to the end of a long readable run
    found = secrets.Scanned(pa.array([text]))
    row, at = found.pieces()
    assert row.tolist() == [0] * len(row) and at[0] == 19 and at[-1] == found.end[0] - secrets.BODY and (np.diff(at) <= secrets.STEP).all()
    assert secrets.net_spans(found, net).tolist() == [0]
    assert not len(secrets.net_spans(secrets.Scanned(pa.array(["plain words before " + "word" * 100 + " and after"])), net))


def test_windows_stay_inside_their_text(net):
    texts = ["abcdefgh", None, "é ABCDEFGH12345678 x", "0123456789abcdefg" * 4]
    found = secrets.Scanned(pa.array(texts))
    w = found.windows(np.arange(len(found.start)))
    assert w[: secrets.BEFORE, 0].sum() == 0 and w[secrets.BEFORE + secrets.BODY :, 0].sum() == 0
    assert bytes(w[secrets.BEFORE - 3 : secrets.BEFORE, 1].astype(np.uint8)) == "é ".encode() and bytes(w[secrets.BEFORE + secrets.BODY :, 1].astype(np.uint8)).rstrip(b"\0") == b" x"
    short = found.windows(np.arange(2), body=16)
    assert np.allclose(net.scores(short), net.scores(w[:, :2]))


def test_thresholds_keep_the_recall_and_add_no_false_finding():
    r = random.Random(4)
    found = [((b"order number is ").rjust(32, b"\0") + some(r, 16, string.digits).encode().ljust(48, b"\0") + b" and so on".ljust(16, b"\0"), 0) for _ in range(200)]
    found += [((b"the key token = ").rjust(32, b"\0") + some(r, 40, "0123456789abcdef").encode().ljust(48, b"\0") + b" and so on".ljust(16, b"\0"), 1) for _ in range(200)]
    windows, y = secrets.labelled(found, 300)
    held, net = np.arange(len(y)) % 3 == 0, secrets.Net()
    net.train(windows[:, ~held], y[~held])
    net.calibrate(windows[:, held], y[held], 0.95)
    p, long = net.scores(windows[:, held]), secrets.lengths_of(windows[:, held]) >= secrets.LONG
    for part in (False, True):
        true = p[(y[held] == 1) & (long == part)]
        assert (true >= net.thresholds[part]).mean() >= 0.95


def test_every_candidate_of_every_text_takes_part(spark, net):
    """More texts than any bound of a sample (20,000 before): counts, sums of a step and held-out scores against all of them."""
    texts = [f"number {i} is password=word{i:07}" if i % 5000 == 0 else f"é candidate{i:06} of some" for i in range(30_000)] + [None, "", "12345678"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = secrets.Scanned(pa.array(texts))
    label, held = found.covered(), secrets._sides(found)
    assert len(label) == 30_001 and label.sum() == 6
    grams = {r["gram"]: r["n"] for r in secrets.gram_counts(docs, secrets.LEAST).collect()}
    assert grams.pop(-1) == len(label) and sum(grams.values()) == len(found.raw) + 3 * len(texts)
    a, b, c, d = b"cand"
    assert grams[((a * 129 + b) * 129 + c) * 129 + d] == 29_994
    sums = secrets.step_sums(docs, net, secrets.LEAST)
    x = net.features(found.windows(np.arange(len(label))))
    for y in (0, 1):
        rows = ~held & (label == y)
        want = secrets._sums(net, x[rows])[y]
        assert sums[y][0] == rows.sum() and np.allclose(sums[y], want, rtol=1e-3, atol=1e-3 * np.abs(want).max())
    assert sum(r["n"] for r in secrets.held_scores(docs, net, secrets.LEAST).collect()) == held.sum()


def test_the_network_does_not_depend_on_how_texts_are_dealt(spark, net):
    other = secrets.trained(spark.read.parquet(f"{SF}/documents.parquet").repartition(13))
    assert np.allclose(other.last, net.last, atol=1e-4) and np.allclose(other.thresholds, net.thresholds, atol=1e-3)
