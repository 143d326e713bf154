"""Media that this library didn't write: all PNG filters, depths and broken images, WAV chunks, PNM comments, BMP depths, GIF, JPEG."""

import struct
import zlib

import numpy as np
import pytest

from marginalia.llm import media


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(rows, back, filters, width, depth, colour, cut=1, interlaced=0):
    """rows: bytes of each row; filtered the other way round from reading."""
    out, above = b"", bytes(len(rows[0]))
    for row, how in zip(rows, filters):
        line = bytearray([how])
        for x, v in enumerate(row):
            left, corner = (row[x - back], above[x - back]) if x >= back else (0, 0)
            up = above[x]
            p = left + up - corner
            paeth = left if abs(p - left) <= min(abs(p - up), abs(p - corner)) else up if abs(p - up) <= abs(p - corner) else corner
            line.append((v - (0, left, up, (left + up) // 2, paeth)[how]) & 255)
        out, above = out + bytes(line), row
    data = zlib.compress(out)
    parts = [data[i * len(data) // cut : (i + 1) * len(data) // cut] for i in range(cut)]
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, interlaced))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"tEXt", b"k\0v") + b"".join(chunk(b"IDAT", p) for p in parts) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,depth,channels", [(0, 8, 1), (2, 8, 3), (3, 8, 1), (4, 8, 2), (6, 8, 4), (0, 16, 1), (2, 16, 3), (0, 1, 1), (3, 4, 1)])
def test_png_of_all_filters_and_depths(colour, depth, channels):
    r = np.random.default_rng(colour * 100 + depth)
    width = 21
    size = (width * channels * depth + 7) // 8
    rows = [r.integers(0, 256, size, dtype=np.uint8).tobytes() for _ in range(25)]
    blob = png(rows, max(1, channels * depth // 8), [i % 5 for i in range(25)], width, depth, colour, cut=3)
    (found,) = media.sniff(b"junk" + blob + b"tail")
    assert found == media.Medium("image/png", 4, 4 + len(blob))
    assert media.read(blob, media.Medium("image/png", 0, len(blob))) == b"".join(rows)


def test_png_that_is_none():
    head = b"\x89PNG\r\n\x1a\n"
    ihdr = chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0))
    idat = chunk(b"IDAT", zlib.compress(b"\0ab"))
    end = chunk(b"IEND", b"")
    assert media.sniff(head + ihdr + idat + end)
    for bad in (
        head + chunk(b"IHDR", b"") + end,  # empty header
        head + ihdr + end,  # no image
        head + ihdr + chunk(b"IDAT", zlib.compress(b"\0a")) + end,  # too short
        head + ihdr + chunk(b"IDAT", zlib.compress(b"\0abc")) + end,  # too long
        head + ihdr + chunk(b"IDAT", b"no zlib stream") + end,
        head + ihdr + chunk(b"IDAT", zlib.compress(b"\0ab")[:-3]) + end,
        head + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 3, 0, 0, 0, 0)) + idat + end,  # no such depth
        head + chunk(b"IHDR", struct.pack(">IIBBBBB", 0, 1, 8, 0, 0, 0, 0)) + idat + end,
        head + idat + ihdr + end,
    ):
        assert not media.sniff(bad)


def test_interlaced_png_is_confirmed_and_not_read(spark):
    blob = png([b"ab", b"cd"], 1, [0, 0], 2, 8, 0, interlaced=1)
    assert media.read(blob, media.sniff(blob)[0]) is None
    rows = spark.createDataFrame([(1, 0, "image/bmp", bytearray(blob)), (2, 0, None, bytearray(b"none"))], "doc_id long, n_bytes long, declared string, blob binary")
    got = {r["doc_id"]: r for r in media.read_back(rows).collect()}
    assert got[1]["mime"] == "image/png" and got[1]["corrected"] and got[1]["media_bytes"] == len(blob) and got[1]["payload_bytes"] is None and got[1]["feature"] is None
    assert got[2]["mime"] is None and got[2]["media_bytes"] is None


def test_wav_chunks_in_any_order():
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16)
    samples = bytes(range(40))
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + fmt + b"fact" + struct.pack("<I", 4) + b"\0\0\0\0" + b"data" + struct.pack("<I", 40) + samples + b"cue " + struct.pack("<I", 2) + b"zz"
    blob = b"RIFF" + struct.pack("<I", len(body)) + body
    (found,) = media.sniff(blob + b"tail")
    assert found.end == len(blob) and media.read(blob, found) == samples
    assert not media.sniff(b"RIFF" + struct.pack("<I", 28) + b"WAVE" + fmt)  # no samples


def test_pnm_with_comments_and_colours():
    blob = b"P5 # made\n# by hand\n3\n2 255\nabcdef"
    assert media.read(blob, media.sniff(blob)[0]) == b"abcdef"
    colour = b"P6\n1 2\n255\nabcdef"
    assert media.sniff(colour)[0].kind == "image/x-portable-pixmap" and media.read(colour, media.sniff(colour)[0]) == b"abcdef"
    assert not media.sniff(b"P5 3 2 255\nabcde") and not media.sniff(b"P5 0 2 255\n") and not media.sniff(b"P5 words here")


@pytest.mark.parametrize("bits,width,height", [(24, 5, 3), (24, 5, -3), (1, 9, 4), (4, 3, 2), (32, 2, 2)])
def test_bmp_of_other_depths(bits, width, height):
    row, stride = (width * bits + 7) // 8, (width * bits + 31) // 32 * 4
    rows = [bytes([i + 1] * row) for i in range(abs(height))]
    image = b"".join(x.ljust(stride, b"\0") for x in (rows if height < 0 else rows[::-1]))
    blob = b"BM" + struct.pack("<IHHI", 54 + len(image), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, 0, 0, 0, 0, 0) + image
    (found,) = media.sniff(b"BM" + blob)
    assert found.end == 2 + len(blob) and media.read(blob, media.sniff(blob)[0]) == b"".join(rows)


def test_gif_and_jpeg_by_their_structure():
    gif = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6) + b"!\xf9\x04\0\0\0\0\0" + b"," + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + b"\x02\x02\x4c\x01\0" + b";"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">H", 8) + bytes(6) + b"\xff\xda" + struct.pack(">H", 4) + b"cd" + b"scan\xff\x00more\xff\xd0data" + b"\xff\xd9"
    found = media.sniff(b"GIF8 \xff\xd8\xff" + gif + b"--" + jpeg + b"tail")
    assert [(m.kind, m.end - m.start) for m in found] == [("image/gif", len(gif)), ("image/jpeg", len(jpeg))]
    assert media.read(gif, media.sniff(gif)[0]) is None and not media.sniff(gif[:-1]) and not media.sniff(jpeg[:-2])


def test_carved_media_are_listed(spark):
    inner = media.store(media.payload_of(b"inner"), "image/png")
    outer = media.store(media.payload_of(inner), "audio/wav")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x01\x4c\0" + b";"
    blob = outer + gif
    rows = spark.createDataFrame([(1, 0, "audio/wav", bytearray(blob))], "doc_id long, n_bytes long, declared string, blob binary")
    (got,) = media.read_back(rows).collect()
    assert got["n_embedded"] == 2 and got["embedded"] == f"image/gif:{len(outer)}:{len(blob)},samples:image/png:0:{len(inner)}"
    assert [(r["mime"], bytes(r["media"])) for r in media.carved(rows).orderBy("place").collect()] == [("audio/wav", outer), ("image/gif", gif)]


def wav(fmt, channels, bits, data, extra=b""):
    frame = channels * bits // 8
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16 + len(extra), fmt, channels, 8000, 8000 * frame, frame, bits) + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("fmt,bits,extra", [(1, 16, b""), (1, 24, b""), (3, 32, b"\0\0"), (3, 64, b"\0\0"), (6, 8, b"\0\0"), (7, 8, b"\0\0"), (0xFFFE, 16, b"\x16\0" + bytes(22))])
def test_wav_of_all_plain_codings(fmt, bits, extra):
    data = bytes(range(240))
    blob = wav(fmt, 2, bits, data, extra)
    assert media.sniff(b"x" + blob) == [media.Medium("audio/wav", 1, 1 + len(blob))]
    assert media.read(blob, media.Medium("audio/wav", 0, len(blob))) == data
    assert not media.sniff(wav(fmt, 2, bits, data[:-1], extra)) and not media.sniff(wav(2, 2, bits, data, extra))


@pytest.mark.parametrize("coding,size", [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 4), (7, 8), (27, 1)])
def test_au_of_all_plain_codings(coding, size):
    data = bytes(48 * size)
    for n in (len(data), 0xFFFFFFFF):
        blob = b".snd" + struct.pack(">IIIII", 28, n, coding, 8000, 2) + b"note" + data
        assert media.sniff(blob) == [media.Medium("audio/basic", 0, len(blob))]
        assert media.read(blob, media.Medium("audio/basic", 0, len(blob))) == data
    assert not media.sniff(b".snd" + struct.pack(">IIIII", 24, 3, 7, 8000, 2) + data)
    assert not media.sniff(b".snd" + struct.pack(">IIIII", 24, len(data), 23, 8000, 2) + data)


def test_a_comment_of_any_length():
    blob = b"P5 #" + b"c" * 50_000 + b"\n#\n3 2\n# max\n255 " + b"abcdef"
    assert media.sniff(blob) == [media.Medium("image/x-portable-graymap", 0, len(blob))]
    assert media.read(blob, media.Medium("image/x-portable-graymap", 0, len(blob))) == b"abcdef"
