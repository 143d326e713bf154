"""Language identification by compression with per-language zstandard dictionaries.

Each language's dictionary is raw content: the distinct lower-case words of a bounded sample of labelled training
documents (at most `sample_docs` a language, chosen by a hash of doc_id; their whole texts). Words that more of these
documents have stand nearer to its end, so words of another language in a few mixed documents hardly matter. At most
`dictionary_bytes` of them are used, the most frequent ones: more than the words of such a sample take as a rule.
The whole text, in lower case, is compressed in blocks of `block` bytes with each dictionary; the language of the
smallest total wins. The margin is what the second needs more, in proportion. A text whose margin is under
`least_margin` is rejected, whatever its length: it is in none of the languages, or in several, or says too little.

The work is one pass over the texts in tasks, without a shuffle. Of the sample, words are counted in Spark; only a
dictionary's worth of words a language goes to the driver, and the dictionaries go to the tasks.

Nulls: a null text, or one without a letter, is `und`, with score 0, and rejected. A null doc_id is kept. Where no
document has a language (an empty table, say), every text is `und`. A tie goes to the language with more training
documents, then by name. Repeated rows give equal results; rows of one doc_id with unlike texts are told apart. `languages`
reads doc_id and text alone; `kept` passes all other columns on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard as z
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import column, slices, table, texts

UNKNOWN = "und"
#: Zstandard's level and least match, and the bytes that are compressed at once.
LEVEL, MIN_MATCH, BLOCK = 6, 4, 1024
LEAST_MARGIN, SURE_MARGIN = 0.03, 0.1


def id_hash_mod(n: int) -> Column:
    """crc32 of doc_id as text (null as empty), modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def dictionaries(train: DataFrame, sample_docs: int = 200, dictionary_bytes: int = 1 << 20) -> dict[str, bytes]:
    """The raw content of each language's dictionary, most frequent language first; train: doc_id, text, lang."""
    rows = train.where("lang is not null").select("lang", F.col("doc_id").alias("of"), F.xxhash64("text").alias("row"), "text")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("of"), "of", "row")
    chosen = rows.select("lang", F.col("of").alias("c_of"), F.col("row").alias("c_row"), F.row_number().over(by_hash).alias("n")).where(F.col("n") <= sample_docs).withColumnRenamed("lang", "c_lang")
    # at most sample_docs rows a language, so small enough to send to every task
    sample = rows.join(F.broadcast(chosen), (F.col("lang") == F.col("c_lang")) & F.col("of").eqNullSafe(F.col("c_of")) & (F.col("row") == F.col("c_row")), "left_semi").dropDuplicates(["lang", "of", "row"])
    words = sample.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    room = F.sum(F.octet_length("word") + 1).over(Window.partitionBy("lang").orderBy(F.desc("n"), F.desc("word")))
    out: dict[str, list[tuple[int, str]]] = {}
    for r in words.withColumn("room", room).where(F.col("room") <= dictionary_bytes + 1).select("lang", "word", "n").collect():
        out.setdefault(r["lang"], []).append((r["n"], r["word"]))
    often = {r["lang"]: r["count"] for r in train.where("lang is not null").groupBy("lang").count().collect()}
    return {lang: " ".join(w for _, w in sorted(out[lang])).encode() for lang in sorted(out, key=lambda lang: (-often[lang], lang))}


def sizes(raw: bytes, compress: list, block: int = BLOCK) -> list[int]:
    """The bytes that raw takes with each compressor, its blocks one by one."""
    blocks = [raw[i : i + block] for i in range(0, len(raw), block)]
    return [sum(len(c(b)) for b in blocks) for c in compress]


class Compressed:
    """The dictionaries made ready, in one task."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL, min_match: int = MIN_MATCH, block: int = BLOCK):
        self.langs, self.block, self.compress = list(contents), block, []
        for raw in contents.values():
            how = z.ZstdCompressionParameters.from_level(level, min_match=min_match, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.compress.append(z.ZstdCompressor(compression_params=how, dict_data=d).compress)

    def predict(self, text: str) -> tuple[str, float]:
        """Language and margin."""
        if not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        size = sizes(text.lower().encode(), self.compress, self.block)
        first = min(range(len(size)), key=size.__getitem__)
        second = min((s for i, s in enumerate(size) if i != first), default=2 * size[first])
        return self.langs[first], (second - size[first]) / second


def _rejected(lang: str, margin: float, least_margin: float) -> bool:
    return lang == UNKNOWN or margin < least_margin


def languages(docs: DataFrame, contents: dict[str, bytes], least_margin: float = LEAST_MARGIN, sure_margin: float = SURE_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected of each row. score: the margin as a share of sure_margin, at most 1."""
    contents = dict(contents)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressed(contents)
        for batch in slices(batches):
            got = [model.predict(t) for t in texts(column(batch, "text"))]
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([min(1.0, g[1] / sure_margin) for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([_rejected(*g, least_margin) for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *columns], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def kept(docs: DataFrame, contents: dict[str, bytes], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """The rows of docs, all columns, whose text is not rejected; decided where the row is read, so nothing is shuffled."""
    contents = dict(contents)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressed(contents)
        for batch in slices(batches):
            got = [model.predict(t) for t in texts(column(batch, "text"))]
            yield batch.filter(pa.array([not _rejected(*g, least_margin) for g in got], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    contents = dictionaries(docs.where(id_hash_mod(4) != 2))
    held = docs.select("doc_id", "text")
    return languages(held, contents).select("doc_id", (id_hash_mod(4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")
