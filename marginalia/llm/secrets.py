"""Secret scans: base patterns, and a character convolutional network over every candidate with its surroundings.

Base spans follow three patterns (an assignment to a telling name, an access key id, a long hexadecimal run) and always
stay. Candidates are all runs of `least` (8) or more characters of `[A-Za-z0-9+/_.=-]`, whatever is in them and
whether or not a base span overlaps them. Each is read by the network with up to 32 characters before it and 16 after
it; a candidate of over 48 characters is read in overlapping pieces of 48 and gets the highest score. The network
(numpy): one-hot classes of characters, a convolution of width 3, per part (before, candidate, after) the maximum over
all places and for the candidate the sum and mean too, one hidden layer, a probability. Since a place sees three
characters, its filters come from a table of all triples, made once in each task.

What it learns comes from all texts, none of them is left out and none goes to the driver:

* Its filters and hidden layer are taught on made-up text: the counts of all runs of four characters of all texts (those beyond
  ASCII as one) give a chain that text is written by, and the candidates in it are negatives like the corpus's own. Made-up
  secrets (random strings of several alphabets, lengths, tags and parts; passwords beside a name for them) and made-up candidates
  that are none (joined words, numbers, dates, stamps, addresses, versions, identifiers of documents and objects, repeated
  letters, hashes that are named as such) are put in their place. So the network is taught kinds that the patterns do not know.
* Its last layer, over the hidden values and the pooled ones, is fitted by Newton's method on every candidate of every text: of
  label 1 where it overlaps the value that a base pattern found (not the name before it), else 0. Each step is one pass that
  sums gradients and second derivatives. Base findings weigh as much as the made-up secrets at most, and the texts' other
  candidates as much as the made-up ones that are none.
* A third of the candidates (by hash) and of the made-up findings is held out: on all of it, as counts of scores in steps of
  0.01, scores are calibrated (a logistic fit, both labels weighing the same), and for short and long candidates (under `LONG`
  characters or not) the threshold is the highest that still finds at least `recall` of the true findings, lowered to the middle
  of the gap among scores below it.

A candidate whose calibrated score reaches its threshold adds a span of kind `net`.

Six passes over the texts without a shuffle of them: counts, three steps, held-out scores, spans. To the driver go the different
runs of four characters with their counts (129 to the fourth power at most, some 10,000 to some 100,000 in most corpora), the sums
of a step and the counts of scores, whose number does not depend on the texts; the weights go to the tasks. Where the
texts have no candidates (an empty table, say), there is no network and no span of kind `net`.

Nulls: a null text is empty and has no spans; in `redacted` it stays null. A null doc_id is kept. Repeated rows give
equal results. `scan` reads doc_id and text alone; `redacted` passes all other columns on, whatever their names. Places
are counted in code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import wordspans as ws
from marginalia.llm.common import column, slices, table

#: Fixed patterns; on lower-case bytes the first is free of case.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_NAMES = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "net")
LEAST, LONG = 8, 20
BEFORE, BODY, AFTER = 32, 48, 16
STEP = BODY // 2
_RUN = np.ones(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = False


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    #: Where the secret itself starts; before it stands the name that it is assigned to.
    value: int = 0


def base_spans(text: bytes, runs: list[tuple[int, int]]) -> list[Span]:
    """Byte spans of the base patterns; runs: the text's runs of at least 16 characters, which hold all long ones."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [Span(0, m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 8]
    for a, b in runs:
        out += [Span(1, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 16]
        out += [Span(2, m.start(), m.end(), m.start()) for m in _HEX.finditer(text, a, b) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s.start, s.kind))


class Scanned:
    """A slice of texts: its bytes and offsets, the candidates (start, end, document) and each text's base spans."""

    def __init__(self, array: pa.Array, least: int = LEAST):
        self.buf, self.off = ws.bytes_of(array)
        start, end, doc = ws.spans(self.buf, self.off, _RUN)
        size = end - start
        self.raw = self.buf[: self.off[-1]].tobytes()
        rows = np.flatnonzero(size >= 16)
        runs: dict[int, list[tuple[int, int]]] = {}
        for d, a, b in zip(doc[rows].tolist(), start[rows].tolist(), end[rows].tolist()):
            runs.setdefault(d, []).append((a - int(self.off[d]), b - int(self.off[d])))
        self.base = [base_spans(self.text(i), runs.get(i, [])) for i in range(len(self.off) - 1)]
        fit = size >= least
        self.start, self.end, self.doc = start[fit], end[fit], doc[fit]

    def text(self, i: int) -> bytes:
        return self.raw[self.off[i] : self.off[i + 1]]

    def covered(self) -> np.ndarray:
        """Whether the value of a base span overlaps each candidate."""
        change = np.zeros(len(self.raw) + 1, np.int32)
        for i, spans in enumerate(self.base):
            for s in spans:
                change[self.off[i] + s.value] += 1
                change[self.off[i] + s.end] -= 1
        inside = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum(np.cumsum(change[:-1]) > 0, out=inside[1:])
        return inside[self.end] > inside[self.start]

    def windows(self, rows: np.ndarray, at: np.ndarray | None = None, body: int = BODY) -> np.ndarray:
        """BEFORE + body + AFTER bytes for each of the candidates (places by windows), 0 where there is no text or no
        candidate; at: where each window's piece of the candidate starts."""
        start, end, doc = self.start[rows], self.end[rows], self.doc[rows]
        at = start if at is None else at
        parts = []
        for first, n, low, high in ((start - BEFORE, BEFORE, self.off[doc], start), (at, body, at, end), (end, AFTER, end, self.off[doc + 1])):
            place = first + np.arange(n)[:, None]
            parts.append(self.buf.take(place, mode="clip") * ((place >= low) & (place < high)))
        return np.concatenate(parts)

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidate and the start of each piece that the network reads."""
        more = np.maximum(0, -(-(self.end - self.start - BODY) // STEP))
        row = np.repeat(np.arange(len(more)), more + 1)
        step = np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        return row, np.where(step == 0, self.start[row], np.minimum(self.start[row] + step * STEP, self.end[row] - BODY))


# --- the network ---


def _alphabet() -> np.ndarray:
    """Classes of bytes: 0 for none, each letter in either case, digits, marks, blanks, the rest of ASCII, beyond ASCII."""
    out = np.full(256, 69, np.uint8)
    out[97:123], out[65:91], out[48:58] = np.arange(1, 27), np.arange(27, 53), 53
    for i, chars in enumerate((b"+", b"/", b"_", b".", b"=", b"-", b" \t", b"\r\n", b"\"'`", b":", b",;", b"@", b"#%&*$^~", b"()[]{}<>", b"!?|\\")):
        out[list(chars)] = 54 + i
    out[128:] = 70
    out[0] = 0
    return out


CLASSES, WIDTH = 71, 3
_OF = _alphabet()


def _triples(body: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each triple within its part of a window, and the parts' bounds among the triples."""
    cut = ((0, BEFORE), (BEFORE, BEFORE + body), (BEFORE + body, BEFORE + body + AFTER))
    return np.concatenate([np.arange(a, b - WIDTH + 1) for a, b in cut]), np.cumsum([0] + [b - a - WIDTH + 1 for a, b in cut])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """The network's weights, its calibration and thresholds (short, long)."""

    def __init__(self, filters: int = 16, hidden: int = 24, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {f"c{k}": r.normal(0, 0.3, (CLASSES, filters)) for k in range(WIDTH)} | {"cb": np.zeros(filters), "h": r.normal(0, 0.15, (5 * filters, hidden)), "hb": np.zeros(hidden), "o": r.normal(0, 0.3, hidden), "ob": np.zeros(1)}
        self.direct = np.zeros(5 * filters)  # of the pooled values, past the hidden layer
        self.scale, self.shift, self.thresholds = 1.0, 0.0, (0.5, 0.5)
        self.triples: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"triples": None}

    def _table(self) -> np.ndarray:
        if self.triples is None:
            w = {k: self.w[k].astype(np.float32) for k in ("c0", "c1", "c2", "cb")}
            out = np.maximum(w["c0"][:, None, None] + w["c1"][None, :, None] + w["c2"][None, None, :] + w["cb"], 0)
            out[0], out[:, 0], out[:, :, 0] = 0, 0, 0  # a triple that isn't whole says nothing
            self.triples = out.reshape(CLASSES**WIDTH, -1)
        return self.triples

    @staticmethod
    def _pooled(z: np.ndarray, size: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
        parts = [z[a:b] for a, b in zip(bound, bound[1:])]
        total = parts[1].sum(axis=0)
        return [*(p.max(axis=0) for p in parts), total / 24, total / size]

    def features(self, windows: np.ndarray) -> np.ndarray:
        """What the last layer reads: hidden and pooled values and 1. What is beyond a candidate's end adds nothing, so short ones
        may come in shorter windows."""
        x, body = _OF[windows].astype(np.int32), len(windows) - BEFORE - AFTER
        at, bound = _triples(body)
        code = (x[at] * CLASSES + x[at + 1]) * CLASSES + x[at + 2]
        size = np.maximum(1, lengths_of(windows) - WIDTH + 1)[:, None]
        flat = np.concatenate(self._pooled(self._table().take(code, axis=0), size, bound), axis=1)
        hidden = np.maximum(flat @ self.w["h"] + self.w["hb"], 0)
        return np.concatenate([hidden, flat, np.ones((len(flat), 1), flat.dtype)], axis=1)

    @property
    def last(self) -> np.ndarray:
        return np.concatenate([self.w["o"], self.direct, self.w["ob"]]).astype(np.float64)

    @last.setter
    def last(self, weights: np.ndarray) -> None:
        n = len(self.w["o"])
        self.w = self.w | {"o": weights[:n], "ob": weights[-1:]}
        self.direct = weights[n:-1]

    def _logits(self, windows: np.ndarray) -> np.ndarray:
        return self.scale * (self.features(windows) @ self.last) + self.shift

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """Calibrated scores; windows: places by candidates, bytes."""
        return _sigmoid(self._logits(windows))

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.006, seed: int = 11) -> None:
        """Adam on the logistic loss, labels weighted to balance."""
        all_x, r, (place, bound) = _OF[windows], np.random.default_rng(seed), _triples(BODY)
        weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum()))).astype(np.float32)
        sizes = np.maximum(1, lengths_of(windows) - WIDTH + 1).astype(np.float32)[:, None]
        w = {k: x.astype(np.float32) for k, x in self.w.items()}
        m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
        t, eye = 0, np.eye(CLASSES, dtype=np.float32)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(order), batch):
                i = order[at : at + batch]
                x, size = all_x[:, i], sizes[i]
                taps = [x[place + k] for k in range(WIDTH)]
                whole = ((taps[0] > 0) & (taps[1] > 0) & (taps[2] > 0))[:, :, None]
                z = np.maximum(sum(w[f"c{k}"].take(tap, axis=0) for k, tap in enumerate(taps)) + w["cb"], 0) * whole
                flat = np.concatenate(self._pooled(z, size, bound), axis=1)
                h = np.maximum(flat @ w["h"] + w["hb"], 0)
                d = ((_sigmoid(h @ w["o"] + w["ob"][0]) - y[i]) * weight[i] / len(i)).astype(np.float32)
                g = {"o": h.T @ d, "ob": np.array([d.sum()])}
                dh = np.outer(d, w["o"]) * (h > 0)
                g["h"], g["hb"] = flat.T @ dh, dh.sum(axis=0)
                df = np.split(dh @ w["h"].T, 5, axis=1)
                dz = np.zeros_like(z)
                for p, (a, b) in enumerate(zip(bound, bound[1:])):
                    np.put_along_axis(dz[a:b], z[a:b].argmax(axis=0)[None], df[p][None], axis=0)
                dz[bound[1] : bound[2]] += df[3] / 24 + df[4] / size
                dz = (dz * (z > 0)).reshape(-1, z.shape[2])
                g["cb"] = dz.sum(axis=0)
                for k, tap in enumerate(taps):
                    g[f"c{k}"] = eye.take(tap.reshape(-1), axis=0).T @ dz
                t += 1
                for k in w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    w[k] = w[k] - rate * ((m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + 1e-3 * w[k])
        self.w = w
        self.triples = None

    def calibrate(self, windows: np.ndarray, y: np.ndarray, recall: float) -> None:
        """A logistic fit of held-out scores, and the thresholds by length.

        The highest threshold with that recall is lowered as far as no further held-out negative passes it, to the middle
        of the gap: where the labels are well apart, more than the least recall comes at no cost."""
        self.scale, self.shift = 1.0, 0.0
        self.fit_scores(self._logits(windows), y, lengths_of(windows) >= LONG, np.ones(len(y)), recall)

    def fit_scores(self, s: np.ndarray, y: np.ndarray, long: np.ndarray, n: np.ndarray, recall: float) -> None:
        """The same from scores before calibration; n: how much each weighs."""
        self.scale, self.shift = 1.0, 0.0
        weight = n / n.sum()
        for _ in range(300):
            d = (_sigmoid(self.scale * s + self.shift) - y) * weight
            self.scale -= 0.05 * (float((d * s).sum()) + 1e-3 * self.scale)
            self.shift -= 0.05 * float(d.sum())
        s, out = self.scale * s + self.shift, []
        for part in (False, True):
            mine = np.flatnonzero((y == 1) & (long == part))
            mine, false = mine[np.argsort(s[mine], kind="stable")], s[(y == 0) & (long == part)]
            if not len(mine):
                out.append(1.0)
                continue
            true, upto = s[mine], np.cumsum(n[mine])
            top = true[min(len(true) - 1, np.searchsorted(upto, (1 - recall) * upto[-1], side="right"))]
            below = false[false < top].max(initial=-30.0)
            out.append(float(_sigmoid((below + true[true > below][0]) / 2)))
        self.thresholds = tuple(out)


def lengths_of(windows: np.ndarray) -> np.ndarray:
    return (windows[BEFORE : len(windows) - AFTER] > 0).sum(axis=0)


# --- labelled findings ---

_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALPHABETS = ("abcdef" + _DIGITS, "ABCDEF" + _DIGITS, _LOWER + _DIGITS, _LOWER.upper() + "234567", _LOWER.upper() + _DIGITS, _LOWER + _LOWER.upper() + _DIGITS, _LOWER + _LOWER.upper() + _DIGITS + "-_", _LOWER + _LOWER.upper() + _DIGITS + "+/")
_SAYS = ("key", "auth", "pwd", "pass", "password", "passwort", "contraseña", "credential", "access_key", "private key", "client_secret", "secret", "bearer", "apikey", "api key", "login", "token", "signature", "clave", "clé", "Kennwort")
_JOINS = (": ", " = ", "=", ":", ' = "', ": '", " is ", " ", '": "')


def _made(r: random.Random, words: list[str]) -> tuple[str, bool]:
    """A made-up secret, and whether it needs a name before it to be known as one."""

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(r.choices(alphabet, k=r.randint(low, high)))

    kind = r.random()
    if kind < 0.4:
        body = some(r.choice(_ALPHABETS), 16, 64)
        return body + r.choice(("", "", "", "=", "==")), False
    if kind < 0.68:
        tags = [some(_LOWER, 2, 5) for _ in range(r.randint(1, 2))]
        tags[0] = r.choice((tags[0], tags[0].upper(), tags[0].title()))
        sep = r.choice("__-.")
        numbers = [some(_DIGITS, 4, 11) for _ in range(r.choice((0, 0, 1, 2, 2)))]
        return sep.join([*tags, *numbers, some(r.choice(_ALPHABETS[2:]), 16, 48)]), False
    if kind < 0.8:
        return r.choice(".-_").join(some(r.choice(_ALPHABETS[5:7]), 10, 48) for _ in range(r.randint(2, 3))), False
    word = r.choice(words)[: r.randint(3, 8)]
    forms = (word + some(_DIGITS, 2, 5), word.title() + some(_DIGITS, 2, 4) + r.choice(("", ".", "-", "_")) + some(_LOWER, 1, 3), some(_LOWER + _LOWER.upper() + _DIGITS, 9, 15), some(_LOWER + _DIGITS + "-_.+", 9, 15))
    return r.choice(forms).ljust(LEAST, r.choice(_DIGITS)), True


_HASHES = ("sha256: ", "sha1 ", "md5=", "checksum ", "commit ", "digest: ", "etag ", "revision ", "fingerprint ", "hash: ", "sha256=", "tree ", "blob ", "crc ")


def _named_hash(r: random.Random) -> tuple[str, str]:
    """What names a hash as such, and the hash."""
    return r.choice(_HASHES), "".join(r.choices(_ALPHABETS[0], k=r.choice((8, 12, 16, 32, 40, 56, 64))))


def _identifier(r: random.Random, words: list[str]) -> str:
    """An identifier or a stamp that anybody may read."""

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(r.choices(alphabet, k=r.randint(low, high)))

    word, hexes = r.choice(words), _ALPHABETS[0]
    day = f"20{r.randint(0, 39):02}{r.randint(1, 12):02}{r.randint(1, 28):02}"
    time = f"{r.randint(0, 23):02}{r.randint(0, 59):02}{r.randint(0, 59):02}"
    uuid = "-".join(some(hexes, n, n) for n in (8, 4, 4, 4, 12))
    letter = r.choice(_LOWER + _LOWER.upper() + _DIGITS)
    return r.choice((
        uuid, uuid.upper(), f"10.{some(_DIGITS, 4, 5)}/{some(_LOWER + _DIGITS, 4, 12)}", f"10.{some(_DIGITS, 4, 5)}/{word}.{some(_DIGITS, 4, 4)}.{some(_DIGITS, 2, 6)}", f"10.{some(_DIGITS, 4, 4)}/{some(_LOWER, 1, 4)}.{some(_DIGITS, 4, 8)}",
        f"{day}T{time}Z", f"{day}T{time}Z-{some(_LOWER, 2, 3)}{some(_DIGITS, 1, 1)}", f"{day}-{time}", f"build-{day}.{some(_DIGITS, 1, 4)}", f"{word}-{day}{time}", f"{day[:4]}-{day[4:6]}-{day[6:]}T{time[:2]}",
        some(_LOWER.upper(), 1, 3) + some(_DIGITS, 5, 10) + some(_LOWER.upper() + _DIGITS, 0, 2), letter * r.randint(8, 60), letter.upper() * r.randint(8, 40), (letter + r.choice(_LOWER)) * r.randint(5, 30), f"v{some(_DIGITS, 1, 1)}.{some(_DIGITS, 1, 2)}.{some(_DIGITS, 1, 2)}-{some(_DIGITS, 1, 3)}-g{some(hexes, 7, 8)}", f"{word[:4].upper()}-{some(_DIGITS, 3, 6)}", f"{word[:4].upper()}{some(_DIGITS, 6, 12)}",
        f"{some(_DIGITS, 4, 4)}.{some(_DIGITS, 4, 5)}v{some(_DIGITS, 1, 1)}", "-".join(some(_DIGITS, 4, 4) for _ in range(4)), f"978-{some(_DIGITS, 1, 1)}-{some(_DIGITS, 2, 5)}-{some(_DIGITS, 3, 5)}-{some(_DIGITS, 1, 1)}", f"id={some(_DIGITS, 6, 12)}", f"{word}_{day}_{time}.{r.choice(('jpg', 'log', 'csv', 'png'))}",
    ))


def _readable(r: random.Random, words: list[str]) -> tuple[str, bool]:
    """A made-up candidate that is no secret, and whether it still is none after a name for one."""

    def number(low: int, high: int) -> str:
        return "".join(r.choices(_DIGITS, k=r.randint(low, high)))

    some = [r.choice(words) for _ in range(r.randint(2, 5))]
    many = [r.choice(words) for _ in range(r.randint(5, 30))]
    forms = (
        ("".join(many), True), (r.choice(words)[:5] * r.randint(3, 40), True), (r.choice("-_/.").join(many), True), (r.choice("-_/.").join(some), True), ("".join(w.title() for w in some[:3]), True), (some[0] + some[1].title(), True), ("_".join(some[:3]).upper(), True), ("-".join(w.title() for w in some[:3]), True), ("/" + "/".join(some), True),
        (f"www.{some[0]}.{r.choice(('com', 'org', 'de', 'net'))}/{some[1]}", True), (r.choice("=-_.+") * r.randint(8, 60), True), (number(8, 20), False), (f"20{number(2, 2)}-{number(2, 2)}-{number(2, 2)}", True),
        (".".join(number(1, 3) for _ in range(4)), True), (f"{number(3, 3)}-{number(4, 4)}", False), ("-".join(number(3, 5) for _ in range(3)), False), (f"{some[0]}.{number(1, 3)}", False), (f"{some[0]}{number(1, 4)}", False),
        (f"v{number(1, 2)}.{number(1, 2)}.{number(1, 2)}-{some[0]}", True), (f"mail{number(1, 1)}.{some[0]}.com", True), (f"{some[0]}-{number(2, 4)}", False), (f"{some[0]}_{number(1, 2)}.{r.choice(('txt', 'csv', 'html', 'jpg', 'pdf'))}", True), (f"{number(1, 4)}.{number(4, 9)}", False), (r.choice(words).title() + "." + r.choice(words).title(), True),
    )
    body, anyway = r.choice(forms)
    return body if len(body) >= LEAST else body + "." + r.choice(words).ljust(LEAST, "e"), anyway


def labelled(found: list[tuple[bytes, int]], made: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows (places by findings) and labels: what was found, and as many made-up findings of each label as asked for."""
    r = random.Random(seed)
    texts = [w[BEFORE : BEFORE + BODY].rstrip(b"\0").decode("latin-1") for w, y in found if not y]
    words = sorted({t for t in texts if t.isalpha()}) or ["document", "language", "reading", "chapters", "question"]
    rows = list(found)

    def put(window: bytes, body: str, named: bool, label: int, says: str = "") -> None:
        before, after = window[:BEFORE].lstrip(b"\0"), window[BEFORE + BODY :].rstrip(b"\0")
        before += (r.choice(_SAYS) + r.choice(_JOINS)).encode() if named else says.encode()
        if before[-1:] in (b'"', b"'"):
            after = before[-1:] + after
        raw = body.encode()
        at = r.choice(range(0, max(1, len(raw) - BODY + 1), STEP)) if len(raw) > BODY else 0  # any piece of a long one
        rows.append((before[-BEFORE:].rjust(BEFORE, b"\0") + raw[at : at + BODY].ljust(BODY, b"\0") + after[:AFTER].ljust(AFTER, b"\0"), label))

    true = [w for w, y in found if y]
    for i in range(made):
        window = found[r.randrange(len(found))][0]
        if true and i % 8 == 0:  # a finding with characters changed
            body = bytearray(r.choice(true)[BEFORE : BEFORE + BODY].rstrip(b"\0"))
            for _ in range(max(1, len(body) // 6)):
                body[r.randrange(len(body))] = ord(r.choice(_ALPHABETS[5]))
            put(window, body.decode("latin-1"), r.random() < 0.5, 1)
        else:
            body, needs = _made(r, words)
            put(window, body, needs or r.random() < 0.4, 1)
        body, anyway = _readable(r, words)
        put(window, body, anyway and r.random() < 0.3, 0)
        for _ in range(2):
            put(found[r.randrange(len(found))][0], _identifier(r, words), False, 0, r.choice(("", "", "", "id ", "doi:", "see ", "ref ", "build ", "at ")))
        if i % 3 == 0:
            alone = r.choice(words)  # a word with little or nothing around it
            put(bytes(BEFORE + BODY + AFTER), r.choice((str.title, str.lower, str.lower))(alone if len(alone) >= LEAST else alone + r.choice(words).ljust(LEAST, "e")), False, 0, r.choice(("", "", alone[:3].upper() + " ", alone.title() + ". ")))
            says, body = _named_hash(r)
            put(found[r.randrange(len(found))][0], body, False, 0, says)
        if texts and i % 2 == 0:
            shout = found[r.randrange(len(found))]
            if not shout[1]:
                put(shout[0].upper(), shout[0][BEFORE : BEFORE + BODY].rstrip(b"\0").decode("latin-1").upper(), False, 0)
            word = r.choice(words)
            put(window, word if len(word) >= LEAST else word + r.choice(words).ljust(LEAST, "e"), True, 0)
    order = sorted(range(len(rows)), key=lambda i: (ws.xxhash.xxh3_64_intdigest(rows[i][0]), rows[i]))
    raw = np.frombuffer(b"".join(rows[i][0] for i in order), np.uint8).reshape(-1, BEFORE + BODY + AFTER)
    return np.ascontiguousarray(raw.T), np.array([rows[i][1] for i in order], np.float64)


# --- what is learned from the texts ---

GRAM, ALPHABET = 4, 129
RIDGE = 1e-6


def gram_counts(docs: DataFrame, least: int) -> DataFrame:
    """gram (four characters as a number, those beyond ASCII as one, 0 before and after a text) and n, over all texts; under -1 the
    number of candidates."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = Scanned(column(batch, "text"), least)
            size = np.diff(found.off)
            start = found.off[:-1] + np.arange(len(size)) * (GRAM - 1) + GRAM - 1  # of each text among texts with nulls between
            low = np.zeros(int(size.sum()) + (len(size) + 1) * (GRAM - 1), np.int64)
            low[np.arange(int(size.sum())) + np.repeat(start - found.off[:-1], size)] = np.minimum(found.buf[: found.off[-1]], ALPHABET - 1)
            code = np.zeros(len(low) - GRAM + 1, np.int64)
            for k in range(GRAM):
                code = code * ALPHABET + low[k : k + len(code)]
            gram, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(gram, -1)), pa.array(np.append(n, len(found.start)))], names=["gram", "n"])

    return docs.select("text").mapInArrow(task, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def written_by(gram: np.ndarray, n: np.ndarray, chars: int, seed: int = 2) -> list[str]:
    """Made-up texts by the chain that the counts give, in all about so many characters."""
    order = np.argsort(gram)
    gram, upto = gram[order], np.concatenate([[0], np.cumsum(n[order])]).tolist()
    first, at = np.unique(gram // ALPHABET, return_index=True)
    bound = dict(zip(first.tolist(), zip(at.tolist(), [*at[1:].tolist(), len(gram)])))
    char, r, out, now, keep = (gram % ALPHABET).tolist(), random.Random(seed), bytearray(), 0, ALPHABET ** (GRAM - 2)
    for _ in range(chars):
        a, b = bound[now]
        c = char[bisect_right(upto, r.randrange(upto[a], upto[b]), a, b + 1) - 1]
        out.append(c)
        now = now % keep * ALPHABET + c
    return [x.decode("latin-1") for x in bytes(out).split(b"\0") if x]


def _sides(found: Scanned) -> np.ndarray:
    """Which candidates are held out, by their content."""
    return ws.mixed(ws.hashes(*ws.keys(found.buf, found.start, found.end))) % np.uint64(3) == 0


def _parts(found: Scanned, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of the candidates and their windows at a time, those of short ones shorter."""
    short = found.end[rows] - found.start[rows] <= BODY // 3
    for body, some in ((BODY // 3, rows[short]), (BODY, rows[~short])):
        for i in range(0, len(some), 2048):
            yield some[i : i + 2048], found.windows(some[i : i + 2048], body=body)


def _sums(net: Net, x: np.ndarray) -> np.ndarray:
    """Of rows of features, by label (0, 1): their number, the sum of the loss's gradient by the last layer, and of its second
    derivatives (upper triangle)."""
    p = _sigmoid(x @ net.last)
    upper, out = np.triu_indices(x.shape[1]), []
    for y in (0, 1):
        bend = np.flatnonzero(p * (1 - p) > 1e-12)  # the others bend the loss by nothing
        out.append(np.concatenate([[len(x)], (p - y) @ x, ((x[bend] * (p * (1 - p))[bend, None]).T @ x[bend])[upper]]))
    return np.array(out)


def step_sums(docs: DataFrame, net: Net, least: int) -> np.ndarray:
    """_sums of the candidates of all texts that are not held out: label by value."""
    size = len(net.last)
    width = 1 + size + size * (size + 1) // 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in slices(batches):
            found = Scanned(column(batch, "text"), least)
            label = found.covered()
            for rows, windows in _parts(found, np.flatnonzero(~_sides(found))):
                x = net.features(windows)
                for y in (0, 1):
                    mine = label[rows] == y
                    if mine.any():
                        total[y] += _sums(net, x[mine])[y]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * width)), pa.array(total.reshape(-1))], names=["at", "value"])

    out = np.zeros(2 * width)
    for r in docs.select("text").mapInArrow(task, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # as many rows as weights squared
        out[r["at"]] = r["value"]
    return out.reshape(2, width)


def held_scores(docs: DataFrame, net: Net, least: int) -> DataFrame:
    """How many held-out candidates have each label, length class and score before calibration, in steps of 0.01."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = Scanned(column(batch, "text"), least)
            label, long = found.covered(), found.end - found.start >= LONG
            for rows, windows in _parts(found, np.flatnonzero(_sides(found))):
                score = np.rint(100 * np.clip(net.features(windows) @ net.last, -30, 30)).astype(np.int64)
                key, n = np.unique(score * 4 + long[rows] * 2 + label[rows], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return docs.select("text").mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _shares(base: float, other: float, true: float, false: float) -> tuple[float, float, float, float]:
    """How much one base finding, other candidate, made-up secret and made-up candidate that is none weighs."""
    of_base = 0.5 * min(0.5, base / max(1, base + true))
    return of_base / max(1, base), 0.25 / max(1, other), (0.5 - of_base) / max(1, true), 0.25 / max(1, false)


def trained(docs: DataFrame, least: int = LEAST, made: int = 4000, recall: float = 0.95, steps: int = 3) -> Net | None:
    """The network fitted on all documents."""
    counts = gram_counts(docs, least).toArrow()
    gram, n = (counts.column(c).to_numpy() for c in ("gram", "n"))
    if not n[gram == -1].sum():
        return None
    fake = Scanned(pa.array(written_by(gram[gram >= 0], n[gram >= 0], 300_000), pa.string()), least)
    own = fake.windows(np.flatnonzero(~fake.covered())).astype(np.uint8).T
    rows = sorted({(w.tobytes(), 0) for w in own}, key=lambda w: ws.xxhash.xxh3_64_intdigest(w[0]))[: 3 * made // 2]
    windows, y = labelled(rows or [(bytes(BEFORE + BODY + AFTER), 0)], made)
    held, net = np.arange(len(y)) % 3 == 0, Net()
    net.train(windows[:, ~held], y[~held])
    x, truth = net.features(windows[:, ~held]), y[~held] == 1
    for step in range(steps + 4):  # the first four on the made-up findings alone
        seen = step_sums(docs, net, least) if step >= 4 else np.zeros((2, len(_sums(net, x[:1])[0])))
        true, false = _sums(net, x[truth])[1], _sums(net, x[~truth])[0]
        share = _shares(seen[1][0], seen[0][0], true[0], false[0])
        total = sum(s * part for s, part in zip(share, (seen[1], seen[0], true, false)))
        size, last = len(net.last), net.last
        bend = np.zeros((size, size))
        bend[np.triu_indices(size)] = total[1 + size :]
        bend = bend + np.triu(bend, 1).T + RIDGE * np.eye(size)
        net.last = np.round(last - np.linalg.solve(bend, total[1 : 1 + size] + RIDGE * last), 6)  # beyond that lies the order of sums
    score = np.clip(net.features(windows[:, held]) @ net.last, -30, 30)
    told = held_scores(docs, net, least).toArrow().sort_by("key")  # some 24,000 rows at most
    key, n = told.column("key").to_numpy(), told.column("n").to_numpy()
    label, mine = key % 2, y[held]
    share = _shares(n[label == 1].sum(), n[label == 0].sum(), (mine == 1).sum(), (mine == 0).sum())
    weight = np.concatenate([np.where(label == 1, share[0], share[1]) * n, np.where(mine == 1, share[2], share[3])])
    net.fit_scores(np.concatenate([(key // 4) / 100, score]), np.concatenate([label, mine]), np.concatenate([key // 2 % 2 == 1, lengths_of(windows[:, held]) >= LONG]), weight, recall)
    return net


def net_spans(found: Scanned, net: Net) -> np.ndarray:
    """Which candidates the network takes for secrets."""
    row, at = found.pieces()
    score = np.zeros(len(found.start))
    short = found.end[row] - found.start[row] <= BODY // 3
    for body, which in ((BODY // 3, np.flatnonzero(short)), (BODY, np.flatnonzero(~short))):
        for i in range(0, len(which), 2048):
            part = which[i : i + 2048]
            np.maximum.at(score, row[part], net.scores(found.windows(row[part], at[part], body)))
    return np.flatnonzero(score >= np.where(found.end - found.start >= LONG, net.thresholds[1], net.thresholds[0]))


def spans_of(array: pa.Array, net: Net | None, least: int = LEAST) -> Iterator[tuple[bytes, list[Span]]]:
    """Each text with all its spans (bytes) in order."""
    found = Scanned(array, least)
    extra: dict[int, list[Span]] = {}
    for i in net_spans(found, net).tolist() if net else ():
        d = int(found.doc[i])
        extra.setdefault(d, []).append(Span(3, int(found.start[i] - found.off[d]), int(found.end[i] - found.off[d])))
    for d, base in enumerate(found.base):
        yield found.text(d), sorted([*base, *extra.get(d, [])], key=lambda s: (s.start, s.kind))


def _points(text: bytes, places: list[int]) -> list[int]:
    """Byte places as code points."""
    if text.isascii() or not places:
        return places
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return np.searchsorted(starts, places).tolist()


def scan(docs: DataFrame, net: Net | None, least: int = LEAST) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points) of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, spans in spans_of(column(batch, "text"), net, least):
                place = _points(text, [p for s in spans for p in (s.start, s.end)])
                out.append([{"kind": KINDS[s.kind], "start": a, "end": b} for s, a, b in zip(spans, place[::2], place[1::2])])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, net: Net | None, mark: str = "[SECRET]", least: int = LEAST) -> DataFrame:
    """The rows of docs, all columns, with every span (overlapping ones as one) replaced by mark."""
    put = mark.encode()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, place = column(batch, "text"), batch.schema.get_field_index("text")
            out = []
            for (text, spans), null in zip(spans_of(texts, net, least), texts.is_null().to_pylist()):
                parts, at = [], 0
                for i, s in enumerate(spans):
                    if s.start >= at:
                        parts += [text[at : s.start], put]
                    at = max(at, s.end)
                out.append(None if null else b"".join([*parts, text[at:]]) if spans else text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, pa.binary()).cast(pa.string()))

    return docs.mapInArrow(task, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, trained(docs))
    base = F.filter("spans", lambda s: s["kind"] != "net")

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), counts[3])
