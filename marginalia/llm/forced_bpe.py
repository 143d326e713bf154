"""Word-level BPE by forced-boundary splitting, equal to the tokenizers library's encode and decode.

A merge only ever makes tokens of the vocabulary. Where two neighbouring bytes of a word stand side by side in no
token, no merge can join them, so the word may be cut there and its fragments encoded alone; the ids of a text are
those of its fragments in a row. Fragments are short and repeat, so each distinct one of a slice of texts is encoded
once and the ids are gathered back.

Steps: words at ASCII white space -> distinct words -> the vocabulary's normaliser and pattern (by tables for Latin
letters, by the library for words with anything else) -> cut at the byte pairs that no token holds -> distinct
fragments -> merges by the library's BPE model, with the word-end suffix for a word's last fragment only.

Nulls: a null text is an empty one (no ids; the decoded text is empty). Texts with a special token's string are
encoded whole by the library, which takes that string as one id. Repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from marginalia.llm import wordspans as ws
from marginalia.llm.common import column, offsets, ragged, slices, table

SUFFIX = "</w>"
_CUT_AT = np.zeros(256, bool)
_CUT_AT[[9, 10, 13, 32]] = True
#: Below this code point the normaliser and the pattern are told by tables.
_LATIN = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER, _HARD = range(5)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


def _latin() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(_LATIN, _OTHER, np.uint8), np.arange(_LATIN, dtype=np.uint32)
    for c in range(_LATIN):
        category = unicodedata.category(chr(c))
        kind[c] = {"L": _LETTER, "N": _NUMBER}.get(category[0], _OTHER)
        if category == "Cc" or chr(c).isspace() or c == 0x27 or len(chr(c).lower()) > 1 or ord(chr(c).lower()) >= _LATIN:
            kind[c] = _HARD  # contractions, white space of other kinds, letters whose lower case is longer
        else:
            lower[c] = ord(chr(c).lower())
    kind[32] = _SPACE
    return kind, lower


class ForcedBpe:
    def __init__(self, json_path: str, cached: int = 200_000):
        model = json.load(open(json_path, encoding="utf-8"))["model"]
        self.whole = Tokenizer.from_file(json_path)
        self.whole.no_padding()
        self.whole.no_truncation()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.models = (BPE(model["vocab"], merges), BPE(model["vocab"], merges, end_of_word_suffix=SUFFIX))
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.byte_of = {c: i for i, c in enumerate(self.letters)}
        self.token = [self.whole.id_to_token(i).encode() for i in range(self.whole.get_vocab_size())]
        #: Whether some token has the two bytes side by side.
        self.joined = np.zeros((256, 256), bool)
        for token in model["vocab"]:
            b = [self.byte_of[c] for c in token.removesuffix(SUFFIX)]
            self.joined[b[:-1], b[1:]] = True
        self.kind, self.lower = _latin()
        self.known: dict[tuple[bytes, bool], list[int]] = {}
        self.cached = cached

    def _words(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and start, end and word of each piece that the pattern makes of the normalised words."""
        text = b" ".join(found).decode("utf-8")
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        low = code < _LATIN
        kind = np.full(len(code), _HARD, np.uint8)
        kind[low] = self.kind[code[low]]
        word = np.cumsum(code == 32) if len(code) else np.zeros(0, np.int64)
        hard = np.zeros(len(found), bool)
        hard[word[kind == _HARD]] = True
        easy = ~hard[word] if len(code) else np.zeros(0, bool)
        kind[~easy] = _SPACE
        lower = np.full(len(code), 32, np.uint32)
        lower[easy] = self.lower[code[easy]]
        new = kind != _SPACE
        new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        last = kind != _SPACE
        last[:-1] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        at = offsets(1 + (lower >= 128).astype(np.int64))
        start, end, of = at[:-1][new], at[1:][last], word[new]
        parts = [lower.tobytes().decode("utf-32-le").encode("utf-8")]
        size, more = len(parts[0]), ([], [], [])
        for i in np.flatnonzero(hard).tolist():
            for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(found[i].decode("utf-8"))):
                raw = bytes(self.byte_of[c] for c in piece)
                for where, v in zip(more, (size, size + len(raw), i)):
                    where.append(v)
                parts.append(raw)
                size += len(raw)
        start, end, of = (np.concatenate([a, np.array(b, np.int64)]) for a, b in zip((start, end, of), more))
        order = np.argsort(of, kind="stable")
        return np.frombuffer(b"".join(parts) + bytes(ws.KEY_BYTES), np.uint8), start[order], end[order], of[order]

    def _merged(self, fragment: bytes, last: bool) -> list[int]:
        got = self.known.get((fragment, last))
        if got is None:
            got = [t.id for t in self.models[last].tokenize("".join([self.letters[b] for b in fragment]))]
            if len(self.known) >= self.cached:
                self.known.clear()
            self.known[fragment, last] = got
        return got

    def words(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words in a row, and how many each has."""
        buf, start, end, of = self._words(found)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(found), np.int64)
        # fragments: the pieces in a row, cut where no token joins two bytes
        flat = ragged(buf, start, end - start)
        bound = offsets(end - start)
        cut = np.zeros(len(flat) + 1, bool)
        cut[1:-1] = ~self.joined[flat[:-1], flat[1:]]
        cut[bound] = True
        at = np.flatnonzero(cut)
        a, b = at[:-1], at[1:]
        whole_end = np.zeros(len(flat) + 1, bool)
        whole_end[bound] = True
        last = whole_end[b]
        flat = np.concatenate([flat, np.zeros(ws.KEY_BYTES, np.uint8)])
        key, size = ws.keys(flat, a, b)
        first, number = ws.distinct(key, size, last.astype(np.int64))
        raw = flat.tobytes()
        got = [self._merged(raw[x:y], z) for x, y, z in zip(a[first].tolist(), b[first].tolist(), last[first].tolist())]
        n = np.array([len(g) for g in got], np.int64)
        pool = np.array([i for g in got for i in g], np.uint32)
        ids = ragged(pool, offsets(n)[:-1][number], n[number])
        word = of[np.searchsorted(bound, a, side="right") - 1]
        return ids, np.bincount(word, weights=n[number], minlength=len(found)).astype(np.int64)

    def slice(self, array: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
        """ids and the decoded text of each text."""
        buf, off = ws.bytes_of(array)
        start, end, doc = ws.spans(buf, off, _CUT_AT)
        raw = buf[: off[-1]].tobytes()
        bound = ws.per_document(doc, len(off) - 1)
        first, number = ws.distinct(*ws.keys(buf, start, end))
        ids, count = self.words([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
        at = offsets(count)
        pieces = list(map(self.token.__getitem__, ids.tolist()))
        shown = [b" ".join(pieces[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        empty = count == 0
        out = ragged(ids, at[:-1][number], count[number])
        done = offsets(count[number])
        special = any(s in raw for s in self.special)
        for i in range(len(off) - 1):
            if special and any(s in (text := raw[off[i] : off[i + 1]]) for s in self.special):
                got = np.array(self.whole.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.uint32)
                yield got, self.decode(got)
                continue
            mine = number[bound[i] : bound[i + 1]]
            if empty[mine].any():
                mine = mine[~empty[mine]]
            yield out[done[bound[i]] : done[bound[i + 1]]], b" ".join(map(shown.__getitem__, mine.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """What the library's decode() gives with special tokens kept: this vocabulary names no decoder, so the tokens with a space between."""
        return b" ".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def loaded(json_path: str) -> ForcedBpe:
    return ForcedBpe(json_path)


def public() -> str:
    import public_tokenizers as p

    return p.path("word_bpe_49k.json")


def encoded(docs: DataFrame, json_path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded (string) of each document; no shuffle."""
    json_path = json_path or public()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(json_path)
        for batch in slices(batches, most=4 << 20):
            got = list(bpe.slice(column(batch, "text")))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([i.astype("<u4").tobytes() for i, _ in got], pa.binary()), pa.array([d.decode("utf-8") for _, d in got], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, ids binary, decoded string")


def digested(docs: DataFrame, json_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, taken where the ids are made."""
    json_path = json_path or public()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(json_path)
        for batch in slices(batches, most=4 << 20):
            n, ids, decoded = [], [], []
            for i, d in bpe.slice(column(batch, "text")):
                n.append(len(i))
                ids.append(hashlib.sha256(i.astype("<u4")).hexdigest())
                decoded.append(hashlib.sha256(d).hexdigest())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))
