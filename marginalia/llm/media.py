"""Media columns: payloads stored losslessly as media, told apart by their bytes and read back.

Storing. A payload of bytes becomes the samples of one of five formats, chosen by a checksum of the payload: WAV (PCM,
8 bits, mono), AU (8-bit linear), BMP (8-bit grey), PNG (8-bit grey) or PGM. Images are 192 samples wide, so a payload
is padded with spaces to a positive multiple of 192.

Sniffing. One Aho-Corasick automaton over all formats' magic bytes finds every place in a blob where a medium may
start. A validator of that format confirms it: chunk layout, header fields, lengths that agree with each other and with
what follows, checksums where the format has them; of a PNG the image is inflated too. The format confirmed at the start
corrects the declared type; confirmed media elsewhere, outside those already taken, are carved out. Formats: WAV (linear,
float, A-law and mu-law samples, chunks in any order), AU (linear, float, A-law, mu-law, of stated length or up to the end), BMP
and PNG of any depth, PGM and PPM with comments of any length, GIF and JPEG.

Reading. Samples are the bytes of the medium's samples, rows without padding and filters; media whose samples aren't
plain (GIF, JPEG, interlaced PNG, packed BMP) are confirmed and carved, but have no samples.

Texts have no declared type, so `stored` makes one up, from the same checksum, that is often wrong.

Nulls: a null text is an empty payload (192 spaces). A null blob, or an empty one, has no media. A null doc_id is kept.
Equal texts give equal values, repeated rows too; an empty table gives no rows. Columns other than doc_id and text (or
those that `read_back` and `carved` name) are not read, whatever their names. Each row is handled on its own, in one pass
without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import column, slices, table

WIDTH = 192


class Medium(NamedTuple):
    """A confirmed medium: its type, where it starts and ends in the blob, and where its samples are read from."""

    kind: str
    start: int
    end: int


# --- one writer, validator (end of the medium, or 0) and reader (samples) for each format ---


def _wav(p: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(p)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(p)) + p


def _wav_parts(b: bytes | memoryview, at: int) -> tuple[tuple, int, int, int] | None:
    """The fields of the format chunk, where the samples start and end, and the end of the medium."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end, place, form, data = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, None, None
    if end > len(b):
        return None
    while place + 8 <= end:
        kind, n = bytes(b[place : place + 4]), struct.unpack_from("<I", b, place + 4)[0]
        if place + 8 + n > end:
            return None
        if kind == b"fmt " and form is None and n >= 16:
            form = struct.unpack_from("<HHIIHH", b, place + 8)
        elif kind == b"data" and data is None and form:
            data = place + 8, place + 8 + n
        place += 8 + n + (n & 1)
    return (form, *data, end) if form and data and place in (end, end + 1) else None


#: Codings whose samples all take as many bytes: linear, float, A-law, mu-law, and those told further on in the header.
_WAV_PLAIN = (1, 3, 6, 7, 0xFFFE)
#: Bytes that a sample takes by coding: mu-law, linear of 8 to 32 bits, float, double, A-law.
_AU_BYTES = {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 4, 7: 8, 27: 1}
_AU_OPEN = 0xFFFFFFFF  # the length isn't stated: up to the end


def _wav_end(b: memoryview, at: int) -> int:
    parts = _wav_parts(b, at)
    if not parts:
        return 0
    (fmt, channels, rate, per_second, frame, bits), start, stop, end = parts
    return end if fmt in _WAV_PLAIN and channels and frame == channels * ((bits + 7) // 8) and per_second == rate * frame and (stop - start) % frame == 0 else 0


def _wav_read(b: bytes) -> bytes:
    _, start, stop, _ = _wav_parts(b, 0)
    return b[start:stop]


def _au(p: bytes) -> bytes:
    return b".snd" + struct.pack(">IIIII", 24, len(p), 2, 8000, 1) + p


def _au_end(b: memoryview, at: int) -> int:
    if len(b) < at + 24:
        return 0
    head, n, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    n = len(b) - at - head if n == _AU_OPEN else n
    end, frame = at + head + n, _AU_BYTES.get(coding, 0) * channels
    return end if head >= 24 and frame and rate and channels < 9 and n >= 0 and n % frame == 0 and end <= len(b) else 0


def _au_read(b: bytes) -> bytes:
    return b[struct.unpack_from(">I", b, 4)[0] :]


def _bmp(p: bytes) -> bytes:
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    return b"BM" + struct.pack("<IHHI", 1078 + len(p), 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, WIDTH, -(len(p) // WIDTH), 1, 8, 0, len(p), 2835, 2835, 256, 0) + palette + p


def _bmp_end(b: memoryview, at: int) -> int:
    if len(b) < at + 54:
        return 0
    size, r1, r2, data = struct.unpack_from("<IHHI", b, at + 2)
    head, width, height, planes, bits, packing, image = struct.unpack_from("<IiiHHII", b, at + 14)
    good = not r1 and not r2 and head in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and packing in (0, 1, 2, 3) and width > 0 and height and data >= 14 + head
    if not good or at + size > len(b):
        return 0
    plain = (width * bits + 31) // 32 * 4 * abs(height)
    return at + size if image <= size - data and (packing in (1, 2) and image or image in (0, plain) and size >= data + plain and size - data - plain < 4) else 0


def _bmp_read(b: bytes) -> bytes | None:
    data, (width, height) = struct.unpack_from("<I", b, 10)[0], struct.unpack_from("<ii", b, 18)
    bits, packing = struct.unpack_from("<HI", b, 28)
    if packing in (1, 2):
        return None
    row, stride = (width * bits + 7) // 8, (width * bits + 31) // 32 * 4
    rows = np.frombuffer(b, np.uint8, stride * abs(height), data).reshape(abs(height), stride)[:, :row]
    return (rows if height < 0 else rows[::-1]).tobytes()


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _png(p: bytes) -> bytes:
    rows = np.zeros((len(p) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(p, np.uint8).reshape(-1, WIDTH)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


#: Channels of each colour type, and the depths it may have.
_PNG_COLOURS = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}


def _png_shape(b: bytes | memoryview, at: int) -> tuple[int, int, int, bool] | None:
    """Bytes of a row without its filter, rows, bytes from a sample to the next pixel's, and whether it is interlaced."""
    width, height, depth, colour, packing, filters, interlaced = struct.unpack_from(">IIBBBBB", b, at + 16)
    channels, depths = _PNG_COLOURS.get(colour, (0, ()))
    if not width or not height or depth not in depths or packing or filters or interlaced > 1:
        return None
    return (width * channels * depth + 7) // 8, height, max(1, channels * depth // 8), bool(interlaced)


def _png_chunks(b: bytes | memoryview, at: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of each chunk's body."""
    place = at + 8
    while place + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, place)
        yield bytes(b[place + 4 : place + 8]), place + 8, place + 8 + n
        place += 12 + n


def _png_end(b: memoryview, at: int) -> int:
    inflate, size, shape, ended = zlib.decompressobj(), 0, None, False
    for kind, start, end in _png_chunks(b, at):
        if end + 4 > len(b) or (shape is None) != (kind == b"IHDR") or struct.unpack_from(">I", b, end)[0] != zlib.crc32(b[start - 4 : end]):
            return 0
        if kind == b"IHDR":
            shape = _png_shape(b, at) if end - start == 13 else None
            if not shape:
                return 0
        elif kind == b"IDAT":
            try:
                part = b[start:end]
                while len(part):  # a piece at a time: only its length is looked at
                    size += len(inflate.decompress(part, 1 << 20))
                    part = inflate.unconsumed_tail
            except zlib.error:
                return 0
            ended = inflate.eof
        elif kind == b"IEND":
            row, rows, _, interlaced = shape
            return end + 4 if ended and end == start and (interlaced or size == (row + 1) * rows) else 0
    return 0


def _png_read(b: bytes) -> bytes | None:
    row, rows, back, interlaced = _png_shape(b, 0)
    if interlaced:
        return None
    raw = np.frombuffer(zlib.decompress(b"".join(b[start:end] for kind, start, end in _png_chunks(b, 0) if kind == b"IDAT")), np.uint8).reshape(rows, row + 1)
    if not raw[:, 0].any():
        return raw[:, 1:].tobytes()
    out, above = np.zeros((rows, row), np.uint8), np.zeros(row, np.uint8)
    for i, (how, line) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:])):
        if how == 0:
            out[i] = line
        elif how == 1:  # each channel is a running sum, modulo 256
            for c in range(back):
                out[i, c::back] = np.cumsum(line[c::back], dtype=np.uint8)
        elif how == 2:
            out[i] = line + above
        elif how in (3, 4):
            _unfiltered(line.tolist(), above.tolist(), back, how, out[i])
        else:
            return None
        above = out[i]
    return out.tobytes()


def _unfiltered(line: list[int], above: list[int], back: int, how: int, out: np.ndarray) -> None:
    """Rows whose bytes follow from the ones before: by the mean of left and above, or by the nearest of three."""
    got: list[int] = []
    for x, value in enumerate(line):
        left, corner = (got[x - back], above[x - back]) if x >= back else (0, 0)
        if how == 3:
            guess = (left + above[x]) // 2
        else:
            slope = left + above[x] - corner
            guess = min((left, above[x], corner), key=lambda near: abs(slope - near))
        got.append((value + guess) & 255)
    out[:] = got


def _pgm(p: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(p) // WIDTH) + p


_PNM = re.compile(rb"P[56](?:\s|#[^\n]*\n)+(\d{1,9})(?:\s|#[^\n]*\n)+(\d{1,9})(?:\s|#[^\n]*\n)+(\d{1,5})\s")


def _pnm_parts(b: bytes, at: int) -> tuple[int, int] | None:
    """Where the samples start and end."""
    head = _PNM.match(b, at)
    if not head:
        return None
    width, height, most = map(int, head.groups())
    n = width * height * (3 if head[0][1:2] == b"6" else 1) * (1 if most < 256 else 2)
    return (head.end(), head.end() + n) if n and 0 < most < 65536 else None


def _pnm_end(b: memoryview, at: int) -> int:
    parts = _pnm_parts(b, at)
    return parts[1] if parts and parts[1] <= len(b) else 0


def _pnm_read(b: bytes) -> bytes:
    start, stop = _pnm_parts(b, 0)
    return b[start:stop]


def _gif_end(b: memoryview, at: int) -> int:
    """Screen, then blocks up to the trailer; each block's parts state their lengths."""

    def past(place: int) -> int:
        while place < len(b) and b[place]:
            place += 1 + b[place]
        return place + 1

    if len(b) < at + 13 or b[at + 4 : at + 6] not in (b"7a", b"9a"):
        return 0
    flags, place, images = b[at + 10], at + 13, 0
    place += 3 << ((flags & 7) + 1) if flags & 128 else 0
    while place < len(b):
        if b[place] == 0x3B:
            return place + 1 if images else 0
        if b[place] == 0x21:
            place = past(place + 2)
        elif b[place] == 0x2C and place + 10 < len(b):
            flags = b[place + 9]
            place = past(place + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
            images += 1
        else:
            return 0
    return 0


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _jpeg_end(b: memoryview, at: int) -> int:
    """Segments with their lengths, a frame before a scan, scans up to the end mark."""
    place, frame, scan = at + 2, False, False
    while place + 4 <= len(b) and b[place] == 0xFF:
        mark, n = b[place + 1], struct.unpack_from(">H", b, place + 2)[0]
        if mark < 0xC0 or 0xD0 <= mark <= 0xD9 or n < 2 or place + 2 + n > len(b):
            break
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        place += 2 + n
        if mark == 0xDA:
            found = _SCAN_END.search(b, place) if frame else None
            if not found:
                return 0
            place, scan = found.start(), True
    return place + 2 if scan and bytes(b[place : place + 2]) == b"\xff\xd9" else 0


def _unread(b: bytes) -> None:
    """Samples that aren't plain."""


#: Type: magic bytes, writer (None: only read), validator, reader.
FORMATS: dict[str, tuple[bytes, Callable | None, Callable, Callable]] = {
    "audio/wav": (b"RIFF", _wav, _wav_end, _wav_read),
    "audio/basic": (b".snd", _au, _au_end, _au_read),
    "image/bmp": (b"BM", _bmp, _bmp_end, _bmp_read),
    "image/png": (b"\x89PNG\r\n\x1a\n", _png, _png_end, _png_read),
    "image/x-portable-graymap": (b"P5", _pgm, _pnm_end, _pnm_read),
    "image/x-portable-pixmap": (b"P6", None, _pnm_end, _pnm_read),
    "image/gif": (b"GIF8", None, _gif_end, _unread),
    "image/jpeg": (b"\xff\xd8\xff", None, _jpeg_end, _unread),
}
KINDS = tuple(kind for kind, (_, write, *_) in FORMATS.items() if write)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (magic, *_) in FORMATS.items():
        text = magic.decode("latin-1")
        out.add_word(text, (kind, len(text)))
    out.make_automaton()
    return out


def sniff(blob: bytes | None, carve: bool = True) -> list[Medium]:
    """Confirmed media in order, none inside another; with carve=False only one that starts the blob."""
    found, free, view = [], 0, memoryview(blob or b"")
    text = str(view if carve else view[:16], "latin-1")
    for last, (kind, n) in _automaton().iter(text):
        at = last + 1 - n
        if at >= free and (end := FORMATS[kind][2](view, at)):
            found.append(Medium(kind, at, end))
            free = end
            if not carve:
                break
    return found


def store(payload: bytes, kind: str) -> bytes:
    return FORMATS[kind][1](payload)


def read(blob: bytes, medium: Medium) -> bytes | None:
    """The samples of a confirmed medium; None where they aren't plain."""
    return FORMATS[medium.kind][3](blob[medium.start : medium.end])


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH))


def features(kind: str, samples: bytes) -> str:
    """A short description of samples: their number, mean, deviation, range, mean step and entropy."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    share = count[count > 0] / len(x)
    value = np.arange(256)
    mean = float((count * value).sum() / len(x))
    spread = float(np.sqrt(max(0.0, (count * value * value).sum() / len(x) - mean * mean)))
    step = float(np.abs(np.diff(x.astype(np.int16))).sum() / max(1, len(x) - 1))
    low, high = np.flatnonzero(count)[[0, -1]]
    return f"{kind};n={len(x)};mean={mean:.3f};sd={spread:.3f};range={low}-{high};step={step:.3f};bits={float(-(share * np.log2(share)).sum()):.4f}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared (a type that may be wrong) and blob (the stored form) of each text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [t or b"" for t in column(batch, "text").cast(pa.binary()).to_pylist()]
            mark = [zlib.crc32(r) for r in raw]
            blobs = [store(payload_of(r), KINDS[m % len(KINDS)]) for r, m in zip(raw, mark)]
            declared = [KINDS[(m // len(KINDS)) % len(KINDS)] for m in mark]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(declared, pa.string()), pa.array(blobs, pa.binary())], names=["doc_id", "n_bytes", "declared", "blob"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_bytes long, declared string, blob binary")


def read_back(blobs: DataFrame) -> DataFrame:
    """Adds what the blob's bytes say: the corrected type, the medium, the payload, and the media it embeds.

    embedded: type:start:end of each medium carved out of the blob behind its own one, or out of the samples ("samples:" in
    front). Rows whose blob doesn't start with a confirmed medium keep their declared type, those whose samples can't
    be read keep the medium; both have nulls for the rest."""
    kinds = "mime string, corrected boolean, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, n_embedded int, embedded string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob, declared in zip(column(batch, "blob").to_pylist(), column(batch, "declared").to_pylist()):
                found = sniff(blob)
                own = next((m for m in found if m.start == 0), None)
                listed = [f"{m.kind}:{m.start}:{m.end}" for m in found if m is not own]
                if not own:
                    rows.append((declared, False, *[None] * 6, len(listed), ",".join(listed)))
                    continue
                samples, medium = read(blob, own), (own.kind, own.kind != declared, own.end, hashlib.sha256(blob[: own.end]).hexdigest())
                if samples is None:
                    rows.append((*medium, *[None] * 4, len(listed), ",".join(listed)))
                    continue
                # media that the samples themselves hold, told from the payload as it was before it was stored
                listed += [f"samples:{m.kind}:{m.start}:{m.end}" for m in sniff(samples)]
                rows.append((*medium, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), features(own.kind, samples), len(listed), ",".join(listed)))
            types = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()]
            names = ["mime", "corrected", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "n_embedded", "embedded"]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types))], names=["doc_id", "n_bytes", *names])

    return blobs.mapInArrow(task, f"doc_id long, n_bytes long, {kinds}")


def carved(blobs: DataFrame, blob: str = "blob", key: str = "doc_id") -> DataFrame:
    """A row for each confirmed medium of each blob: key, place, mime, start, end and its bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, m.kind, m.start, m.end, b[m.start : m.end]) for k, b in zip(column(batch, key).to_pylist(), column(batch, blob).to_pylist()) for i, m in enumerate(sniff(b))]
            types = [column(batch, key).type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=[key, "place", "mime", "start", "end", "media"])

    return blobs.select(key, blob).mapInArrow(task, f"{key} {blobs.schema[key].dataType.simpleString()}, place int, mime string, start long, end long, media binary")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(stored(table(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "mime", "corrected", "n_embedded", "embedded")
