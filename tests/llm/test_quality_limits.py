"""The verdict of the quality check against brute force, its limits, its guard and its classes of characters."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marginalia.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def character_class(c):
    kinds = ("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".,;:", "!?'\"()-", "#*$%&|<>@[]{}=+/\\^_`~")
    raw = c.encode()
    return (raw[0], raw[-1] >> 3 & 7) if len(raw) > 1 else next((i for i, k in enumerate(kinds) if c in k), 9)


def jensen_shannon(p, q):
    p, q = ({k: v / sum(x.values()) for k, v in x.items()} for x in (p, q))
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    return math.sqrt(max(0.0, sum(v * math.log2(v / m[k]) for x in (p, q) for k, v in x.items() if v) / 2))


def lower(word):
    return re.sub("[A-Z]", lambda m: m.group().lower(), word)


def test_verdicts_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    refs = quality.References.of(docs)
    limits = quality.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"), refs)
    got = {r["doc_id"]: r for r in quality.op10_quality(spark, sf).collect()}
    known = {w.decode() for listed in refs.words.values() for w in listed}
    chars, words = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    own = {}
    for r in docs.collect():
        w = WORD.findall(r["text"] or "")
        own[r["doc_id"]] = collections.Counter(map(character_class, r["text"] or "")), collections.Counter(x if (x := lower(v)) in known else None for v in w), len(w)
        if r["lang"] and not got[r["doc_id"]]["base_failed"]:
            chars[r["lang"]] += own[r["doc_id"]][0]
            words[r["lang"]] += own[r["doc_id"]][1]
    checked = 0
    for d, (c, w, n) in own.items():
        if got[d]["base_failed"]:
            assert not got[d]["kept"]
            continue
        dc, dw = min(((jensen_shannon(c, chars[x]), jensen_shannon(w, words[x])) for x in chars), key=sum)
        assert abs(dc - got[d]["class_distance"]) < 1e-6 and abs(dw - got[d]["word_distance"]) < 1e-6
        far = n >= 75 and (dc - limits.class_slope / math.sqrt(n) > limits.class_limit or dw - limits.word_slope / math.sqrt(n) > limits.word_limit)
        assert got[d]["kept"] == (not far)
        checked += far
    assert checked > 0


def test_guard_and_limits_change_verdicts(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(i, i + 60)) + " ok" * (i % 3), "en") for i in range(30)] + [(100, "ZZ!! " * 30 + " ".join(f"QQ{j}!!" for j in range(40)), None), (101, " ".join(f"QQ{j}!!" for j in range(60)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.References.of(docs)

    def kept(**how):
        return {r["doc_id"] for r in quality.judged(docs, refs, **how).where("kept").collect()}

    tight = quality.Limits(0.0, 0.05, 0.0, 0.05)
    assert 101 in kept(limits=tight) and 101 not in kept(limits=tight, guard_words=0)
    assert kept(limits=quality.Limits(0.0, 1.0, 0.0, 1.0)) >= {100, 101}


def test_limits_are_fitted_on_labels(spark):
    r = np.random.default_rng(1)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows, labels = [], []
    for i in range(300):
        n = int(r.integers(80, 400))
        good = i % 5 > 0
        rows.append((i, " ".join(r.choice(vocabulary, n)) if good else " ".join("X#%d!" % k for k in r.integers(0, 999, n)), "en" if good else None))
        labels.append((i, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    refs = quality.References.of(docs)
    limits = quality.fitted(docs, marks, refs)
    got = quality.judged(docs, refs, limits).join(marks, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {x["quality"]: x["share"] for x in got}
    assert share[1] > 0.97 and share[0] < 0.05
    assert quality.fitted(docs, marks.where("quality = 1"), refs) == quality.LIMITS and quality.fitted(docs, marks, quality.References({}, {})) == quality.LIMITS


def test_scripts_beyond_latin_have_many_classes():
    for text in ("съешь ещё этих мягких французских булок", "स्वतंत्रता और समानता का अधिकार", "天地玄黄宇宙洪荒", "😀😺🙂 mixed é"):
        _, found = quality.measured(pa.array([text, "plain", None]))
        chars, _ = quality.histograms(found, {})
        want = collections.Counter(map(character_class, text))
        assert sorted(chars[0][chars[0] > 0].tolist()) == sorted(want.values()) and chars[1].sum() == 5 and chars[2].sum() == 0
        assert (chars[0] > 0).sum() >= 4


def test_limits_take_all_labelled_documents(spark):
    """More rows than any bound of a sample: against numpy over all of them."""
    r = np.random.default_rng(3)
    n, good = r.integers(75, 900, 9000), r.random(9000) < 0.7
    dc = 0.1 + 2.0 / np.sqrt(n) + r.normal(0, 0.02, 9000) + np.where(good, 0, 0.07)
    dw = 0.2 + 1.0 / np.sqrt(n) + r.normal(0, 0.02, 9000) + np.where(good, 0, 0.01)
    rows = [(i, int(n[i]), False, float(dc[i]), float(dw[i])) for i in range(9000)]
    measures = spark.createDataFrame(rows, "doc_id long, n_words long, base_failed boolean, class_distance double, word_distance double")
    got = quality.fitted_on(measures, spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int"))
    for d, slope, limit in ((dc, got.class_slope, got.class_limit), (dw, got.word_slope, got.word_limit)):
        line = np.stack([1 / np.sqrt(n[good]), np.ones(good.sum())], axis=1)
        assert abs(slope - np.linalg.lstsq(line, d[good], rcond=None)[0][0]) < 1e-6
        left = d - slope / np.sqrt(n)
        mine, bad = np.sort(left[good]), left[~good]
        places = [*mine[int(0.995 * (len(mine) - 1)) :], np.inf]
        gains = [(bad > p).mean() - (mine > p).mean() for p in places]
        assert abs(limit - places[len(places) - 1 - int(np.argmax(gains[::-1]))]) < 1e-12
