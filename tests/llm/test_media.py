"""Media: exact round trips, corrected types, carved media, spoilt media."""

import hashlib
import zlib

import pytest

from marginalia.llm import media


@pytest.mark.parametrize("kind", media.KINDS)
def test_round_trip(kind):
    for text in (b"", b"a", b"x" * 192, "é漢😀\0".encode() * 777, b"RIFFBM\x89PNG\r\n\x1a\nP5\n.snd" * 40):
        payload = media.payload_of(text)
        blob = media.store(payload, kind)
        assert len(payload) % 192 == 0 and payload.startswith(text) and not payload[len(text) :].strip(b" ")
        assert media.sniff(blob, carve=False) == [media.Medium(kind, 0, len(blob))]
        assert media.read(blob, media.sniff(blob)[0]) == payload


def test_carving_finds_all_and_no_other():
    parts = [media.store(media.payload_of(bytes([65 + i]) * (100 * i + 1)), k) for i, k in enumerate(media.KINDS)]
    blob = b"junk BM RIFF \x89PNG" + b"--gap--".join(parts) + b"P5\n tail"
    found = media.sniff(blob)
    assert [m.kind for m in found] == list(media.KINDS)
    assert [blob[m.start : m.end] for m in found] == parts


@pytest.mark.parametrize("kind", media.KINDS)
def test_cut_media_are_not_confirmed(kind):
    blob = media.store(media.payload_of(b"some text" * 50), kind)
    assert not media.sniff(blob[:-1]) and not media.sniff(blob[:20]) and not media.sniff(b"")


def test_spoilt_png_is_not_confirmed():
    blob = bytearray(media.store(media.payload_of(b"some text" * 50), "image/png"))
    blob[50] ^= 1
    assert not media.sniff(bytes(blob))


def test_op1_over_whole_texts(spark, sf, docs):
    got = {r["doc_id"]: r for r in media.op1_media(spark, sf).collect()}
    for d, t in docs:
        p = media.payload_of((t or "").encode())
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        blob = media.store(p, r["mime"])
        assert (r["media_bytes"], r["media_sha256"]) == (len(blob), hashlib.sha256(blob).hexdigest())


def test_op1_edges(spark, edge, empty):
    got = [r for r in media.read_back(media.stored(edge)).collect()]
    assert len(got) == 12 and {r["payload_bytes"] for r in got if r["doc_id"] in (2, 3)} == {192}
    same = [tuple(r)[1:] for r in got if r["doc_id"] in (1, 8)]
    assert same[0] == same[1]
    assert media.read_back(media.stored(empty)).count() == 0
    none = spark.createDataFrame([(1, 3, "image/png", b"no medium"), (2, 0, None, None)], "doc_id long, n_bytes long, declared string, blob binary")
    assert {r["mime"] for r in media.read_back(none).collect()} == {"image/png", None}
    assert media.carved(none).count() == 0
