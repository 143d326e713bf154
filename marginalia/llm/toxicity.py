"""Toxicity by a learned lexicon, with Levenshtein automata for misspelled terms and context windows for quotation.

Learning, on a bounded sample of labelled documents (at most `sample_docs` rows, chosen by hash): a term is a lower-case
word, or the first 5 to 7 letters of words (a stem); the lexicon has all that stand in at least `least_docs` toxic documents
of the sample and of whose documents at least `precision` are toxic; longer terms that a stem covers are left out, unless they
may have more edits than it. Sums per term are made in Spark; the lexicon and the features of the sample go to the driver.

Matching. The lexicon is a trie. A word runs through the trie and the Levenshtein automata of all terms at once: a state
is the set of (trie node, edits so far), made when it is first met and then kept, so a word costs one table look-up a
letter and most words end after a few. A term of 5 letters or more may have one edit and one of 9 or more two, at any
place, its first letter included; a stem also takes what follows it. Where no part of a token matches, the token is
matched as it stands, with the digits and marks inside it. Each distinct word of a slice of texts is matched once.

Context. A hit weighs 1, or half of that for each edit. It is quoted if a quotation is open where it stands: a mark at most
`context` words before it opens one that no mark between them closes, and the first mark of that kind at most as many words
after it closes it. Marks within a word (apostrophes) are none; straight marks open before and close behind what they
touch. Quoted and free hits are counted apart. A logistic regression over
free and quoted hits, their share of the words, the number of different terms and the edits gives the score; its weights are
fitted on the same sample.

Nulls: a null text is empty; empty texts get the score of no hits. Labels that are null are not used; if a document has
several, the highest counts. Where the sample has no toxic document (an empty table, say), the lexicon is empty and every
score is the share of toxic labels (0). Repeated rows give equal results. Columns other than doc_id, text and toxic are
not read, whatever their names. Two passes over texts (the first over the sample), no shuffle of texts beyond the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import wordspans as ws
from marginalia.llm.common import column, slices, table, texts, written
from marginalia.llm.language_id import id_hash_mod

STEMS = range(5, 8)
_WORD = re.compile(r"[^\W\d_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Marks that open a quotation, and those that may close it.
_CLOSES = {'"': '"', "“": "”“", "”": "”", "„": "“”", "«": "»", "»": "«»", "‹": "›", "›": "‹›", "‘": "’", "‚": "‘’"}
_QUOTES = frozenset("".join((*_CLOSES, *_CLOSES.values())))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms_of(text: str) -> set[str]:
    """Words, and stems with an asterisk."""
    out: set[str] = set()
    for w in set(words_of(text)):
        out.add(w)
        out.update(w[:k] + "*" for k in STEMS if len(w) > k)
    return out


def edits_of(letters: int) -> int:
    """Edits that a term of so many letters may have."""
    return 0 if letters < 5 else 1 if letters < 9 else 2


class Lexicon:
    """Trie and Levenshtein automata of all terms, determinised as words meet them."""

    def __init__(self, terms: list[str], most_states: int = 50_000):
        self.terms, self.most = terms, most_states
        self.child: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]  # term that ends at the node
        self.stem: list[int] = [-1]  # stem that ends at the node
        for i, term in enumerate(terms):
            node = 0
            for c in term.rstrip("*"):
                node = self.child[node].setdefault(c, len(self.child))
                if node == len(self.word):
                    self.child.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
            (self.stem if term.endswith("*") else self.word)[node] = i
        self.own = [edits_of(len(term.rstrip("*"))) for term in terms]
        self.allow = [max((self.own[i] for i in (self.word[n], self.stem[n]) if i >= 0), default=0) for n in range(len(self.child))]
        for node in range(len(self.child) - 1, -1, -1):  # children have higher numbers
            self.allow[node] = max([self.allow[node], *(self.allow[c] for c in self.child[node].values())])
        self._reset()

    def _reset(self) -> None:
        self.known: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state(self._closed([(0, 0)]))

    def _closed(self, todo: list[tuple[int, int]]) -> tuple:
        """Adds letters of the terms that the word leaves out. A part of a state: node (or -1 - stem once a stem is
        complete) and edits; each node once, with the fewest."""
        best: dict[int, int] = {}
        while todo:
            node, k = todo.pop()
            allowed = self.allow[node] if node >= 0 else self.own[-1 - node]
            if k > allowed or best.get(node, allowed + 1) <= k:
                continue
            best[node] = k
            if node >= 0:
                if self.stem[node] >= 0:
                    todo.append((-1 - self.stem[node], k))
                todo += [(c, k + 1) for c in self.child[node].values()]
        return tuple(sorted(best.items()))

    def _state(self, parts: tuple) -> int:
        got = self.known.get(parts)
        if got is None:
            got = self.known[parts] = len(self.sets)
            self.sets.append(parts)
            self.next.append({})
            ends = [(k, self.word[n] if n >= 0 else -1 - n) for n, k in parts if n < 0 or self.word[n] >= 0 and k <= self.own[self.word[n]]]
            self.accepts.append(min(ends)[::-1] if ends else None)
        return got

    def _step(self, at: int, c: str) -> int:
        out = []
        for node, k in self.sets[at]:
            out.append((node, k + (node >= 0)))  # a letter too many; what follows a stem is no edit
            if node >= 0:
                out += [(child, k + (letter != c)) for letter, child in self.child[node].items()]  # the same letter, or a changed one
        parts = self._closed(out)
        return self._state(parts) if parts else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """Term and edits of the best match, or None."""
        if len(self.sets) > self.most:
            self._reset()
        at = self.start
        for c in word:
            to = self.next[at].get(c)
            if to is None:
                to = self.next[at][c] = self._step(at, c)
            if to < 0:
                return None
            at = to
        return self.accepts[at]

    def hits(self, token: str) -> list[tuple[int, int]]:
        """The matches of a token's words, or of the token with its inner digits and marks."""
        words = words_of(token)
        found = [m for w in words if (m := self.match(w))]
        whole = _EDGES.sub("", token.lower())
        if not found and words and whole not in words and (m := self.match(whole)):
            found = [m]
        return found


def _marks(text: str) -> Iterator[tuple[str, bool, bool]]:
    """Quotation marks of a text, and whether each may open or close a quotation; its ends count as parts of words."""
    for i, c in enumerate(text):
        if c in _QUOTES and 0 < i < len(text) - 1:
            before, after = text[i - 1], text[i + 1]
            if not (before.isalnum() and after.isalnum()):
                yield c, not after.isspace() and not before.isalnum(), not before.isspace()


def in_quotation(before: str, after: str) -> bool:
    """Whether what stands between the two texts (a blank at the outer end of each) is quoted. before ends and after starts
    with a letter of it."""
    opened = None
    for c, opens, closes in _marks(before):
        if opened and c in _CLOSES[opened] and closes:
            opened = None
        elif not opened and c in _CLOSES and opens:
            opened = c
    if opened:
        for c, opens, closes in _marks(after):
            if c in _CLOSES[opened] and closes:
                return True
            if c == opened and opens:
                return False
    return False


FEATURES = ("free", "quoted", "share", "different", "edited", "exact")


def _features(words: int, hits: list[tuple[int, int, bool]]) -> list[float]:
    """hits: term, edits, quoted."""
    weight = [0.5**k for _, k, _ in hits]
    free = sum(w for w, h in zip(weight, hits) if not h[2])
    quoted = sum(w for w, h in zip(weight, hits) if h[2])
    exact = sum(1 for h in hits if h[1] == 0 and not h[2])
    return [np.log1p(free), np.log1p(quoted), min(1.0, 20 * free / max(1, words)), np.log1p(len({h[0] for h in hits})), np.log1p(sum(1 for h in hits if h[1])), np.log1p(exact)]


def featured(array: pa.Array, lexicon: Lexicon, context: int) -> np.ndarray:
    """A row of features for each text."""
    buf, off = ws.bytes_of(array)
    start, end, doc = ws.spans(buf, off)
    bound = ws.per_document(doc, len(off) - 1)
    first, number = ws.distinct(*ws.keys(buf, start, end))
    raw = buf[: off[-1]].tobytes()
    got: list[list[tuple[int, int]]] = []
    for a, b in zip(start[first].tolist(), end[first].tolist()):
        got.append(lexicon.hits(raw[a:b].decode("utf-8")) if lexicon.terms else [])
    has = np.array([bool(g) for g in got] or [False])
    at = np.flatnonzero(has[number]) if len(number) else np.zeros(0, np.int64)
    hits: list[list[tuple[int, int, bool]]] = [[] for _ in range(len(off) - 1)]
    for i in at.tolist():
        d = int(doc[i])
        a, b = max(int(bound[d]), i - context), min(int(bound[d + 1]), i + context + 1)
        token = raw[start[i] : end[i]].decode("utf-8")
        letters = list(_WORD.finditer(token))
        lead, rest = token[: letters[0].start() + 1], token[letters[-1].end() - 1 :]
        quoted = in_quotation(f" {raw[start[a] : start[i]].decode('utf-8')}{lead}", f"{rest}{raw[end[i] : end[b - 1]].decode('utf-8')} ")
        hits[d] += [(t, k, quoted) for t, k in got[number[i]]]
    return np.array([_features(int(bound[d + 1] - bound[d]), h) for d, h in enumerate(hits)], np.float64).reshape(-1, len(FEATURES))


class Model:
    def __init__(self, terms: list[str], weights: np.ndarray, bias: float, context: int):
        self.terms, self.weights, self.bias, self.context = terms, weights, bias, context

    def scores(self, array: pa.Array, lexicon: Lexicon) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(featured(array, lexicon, self.context) @ self.weights + self.bias, -30, 30)))


def chosen_terms(counts: list[tuple[str, int, int]], least_docs: int, precision: float) -> list[str]:
    """counts: term, toxic and other documents."""
    good = sorted((c for c in counts if c[1] >= least_docs and c[1] / (c[1] + c[2]) >= precision), key=lambda c: (len(c[0]), -c[1], c[0]))
    stems: set[str] = set()
    out = []
    for term, toxic, _ in good:
        bare = term.rstrip("*")
        cover = [bare[:k] for k in STEMS if bare[:k] in stems]
        if cover and (term != bare or edits_of(len(bare)) <= max(edits_of(len(c)) for c in cover)):
            continue
        out.append((toxic, term))
        if term != bare:
            stems.add(bare)
    return [t for _, t in sorted(out, key=lambda x: (-x[0], x[1]))]


def trained(docs: DataFrame, labels: DataFrame, sample_docs: int = 12_000, least_docs: int = 5, precision: float = 0.9, context: int = 6) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (only rows that may be learned from)."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = docs.select("doc_id", F.xxhash64("text").alias("row")).join(labels, "doc_id")
    chosen = marked.orderBy(F.xxhash64("doc_id", "row"), "doc_id", "row").limit(sample_docs).distinct()
    # at most sample_docs narrow rows, so small enough to send to every task
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).join(F.broadcast(chosen), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    sample = written(rows.select("text", "toxic"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(texts(column(batch, "text")), column(batch, "toxic").to_pylist()):
                seen[bool(toxic)].update(terms_of(text))
            rows = [(t, seen[1][t], seen[0][t]) for t in seen[1]] + [(t, 0, n) for t, n in seen[0].items() if t not in seen[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], names=["term", "toxic", "other"])

    sums = sample.mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    found = sums.where((F.col("toxic") >= least_docs) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("other"))))
    terms = chosen_terms([tuple(r) for r in found.collect()], least_docs, precision)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in slices(batches):
            x = featured(column(batch, "text"), lexicon, context)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), column(batch, "toxic").cast(pa.int32())], names=["x", "y"])

    rows = sample.mapInArrow(read, "x array<double>, y int").collect()
    y = np.array([float(bool(r["y"])) for r in rows])
    if not len(rows) or y.min() == y.max():
        p = float(y.mean()) if len(rows) else 0.0
        return Model([] if not p else terms, np.zeros(len(FEATURES)), 30.0 * (2 * p - 1), context)
    x = np.array([r["x"] for r in rows])
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    w, b = np.zeros(x.shape[1]), 0.0
    design = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for _ in range(30):  # Newton steps with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        curve = design.T @ (design * (p * (1 - p))[:, None]) + np.eye(design.shape[1])
        step = np.linalg.solve(curve, design.T @ (y - p) - np.append(w, 0))
        w, b = w + step[:-1], b + step[-1]
    return Model(terms, w, float(b), context)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(model.scores(column(batch, "text"), lexicon))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = trained(docs, labels.where(id_hash_mod(5) != 0))
    return scored(docs, model).select("doc_id", (id_hash_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
