"""A notes corpus derived from the given tables, so that every operator has whole tables to run on.

A document is a page and its source is its book, of any number of pages. The last line of a text is the page's footnotes, the rest its body.
Sentences of text pages become quoted evidence, statements and relations by rules of arithmetic; some quotes are
spoilt, some references lead nowhere and some pages are lost, so that gates and checks have something to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import scan
from marginalia.sources.shared import spread, written

TYPES = ("definition", "claim", "method", "question", "background")
BASES = ("author", "author-data", "reported")
PART_CHARS = 4_000_000
RELATIONS = ("defines", "supports", "contrasts", "elaborates", "exemplifies", "motivates")


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, page_index, doc_id: the narrow part of pages, numbered without carrying the texts through the sort."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("source", F.lit("")).alias("book_id"))
    numbered = scan.numbered(scan.placed(ids, ["book_id"], ["doc_id"]), ["book_id"], ["doc_id"], "page_no")
    return numbered.select("doc_id", "book_id", (F.col("page_no") - 1).alias("page_index"))


def top_line() -> Column:
    i, n = F.col("page_index"), F.expr("cast(1 + page_index div 8 as string)")
    r = i % 50
    return (
        F.when(i < 2, "")
        .when(r.between(30, 35), F.when(i % 2 == 0, "TABLE B: TOOLS").otherwise("ACCESSORIES"))
        .when(r.between(40, 41), "TABLE L").when(r == 42, "FAMILY").when(r.between(43, 44), "TABLE M").when(r >= 47, "BIBLIOGRAPHY")
        .when(i % 3 == 0, F.concat(F.lit("THE "), F.upper("book_id"), F.lit(" BOOK")))
        .when(i % 5 == 1, F.concat(F.lit("CHAPTER "), n, F.lit(": PART "), F.expr("cast(page_index div 8 as string)")))
        .otherwise(F.concat(F.lit("CHAPTER "), n))
    )


def page_label() -> Column:
    i = F.col("page_index")
    return F.when(i == 0, "i").when(i == 1, "ii").when(i == 7, F.lit(None)).when(i >= 30, (i - 29).cast("string")).otherwise((i - 1).cast("string"))


def pages(numbers: DataFrame, documents: DataFrame) -> DataFrame:
    """book_id, page_index, doc_id, body, footnotes, page_label, page_type, top_line."""
    line = F.split("text", "\n", -1)
    cut = (
        documents.select("doc_id", line.alias("lines")).select(
            "doc_id",
            F.when(F.size("lines") > 1, F.array_join(F.slice("lines", F.lit(1), F.size("lines") - 1), "\n")).otherwise(F.element_at("lines", 1)).alias("body"),
            F.when(F.size("lines") > 1, F.element_at("lines", -1)).otherwise("").alias("footnotes"),
        )
    )
    kind = F.when(F.length("body") < 20, "blank").when(F.col("doc_id") % 17 == 0, "table").when(F.col("doc_id") % 13 == 0, "figure").otherwise("text")
    return numbers.join(cut, "doc_id").select("book_id", "page_index", "doc_id", "body", "footnotes", page_label().alias("page_label"), kind.alias("page_type"), top_line().alias("top_line"))


def normalized_pages(pages: DataFrame) -> DataFrame:
    """Both streams of each page in the form that quotes are matched in, and the footnotes as they are."""
    return pages.select("book_id", "page_index", "doc_id", "page_type", "footnotes", T.normalized(F.col("body")).alias("body_norm"), T.normalized(F.col("footnotes")).alias("foot_norm"))


def sentence_rows(norm: DataFrame) -> DataFrame:
    """k and sent of each sentence of text pages."""
    return norm.where("page_type = 'text'").select("book_id", "page_index", "doc_id", F.posexplode(T.sentences(F.col("body_norm"))).alias("k", "sent"))


def evidence(norm: DataFrame) -> DataFrame:
    """book_id, page_index, doc_id, k, evidence_id, kind, source, excerpt, page_override, and the optional fields; one pass over
    the page streams. k and sent: a sentence of the body, or no k and the footnotes."""
    k, page, doc, no = F.col("k"), F.col("page_index"), F.col("doc_id"), F.lit(None).cast("string")
    body = F.transform(T.sentences(F.col("body_norm")), lambda s, i: F.struct(i.cast("int").alias("k"), s.alias("sent")))
    foot = F.array(F.struct(F.lit(None).cast("int").alias("k"), F.col("footnotes").alias("sent")))
    both = F.concat(F.coalesce(body, F.slice(foot, F.lit(1), F.lit(0))), foot)
    rows = norm.where("page_type = 'text'").select("book_id", "page_index", "doc_id", F.explode(both).alias("x")).select("book_id", "page_index", "doc_id", "x.k", "x.sent")
    used = F.when(k.isNull(), (doc % 4 == 0) & (F.trim("sent") != "")).otherwise((F.length("sent") >= 15) & ((k + page) % 3 == 0))
    own, figure = k.isNotNull(), F.coalesce((k * 7 + doc) % 29 == 0, F.lit(False))
    return rows.where(used).select(
        "book_id", "page_index", "doc_id", "k", F.when(own, F.concat(F.lit("e-"), k.cast("string"))).otherwise("e-f").alias("evidence_id"), F.when(figure, "figure").otherwise("text").alias("kind"), F.when(own, "body").otherwise("footnote").alias("source"),
        F.when((k * 31 + doc) % 11 == 0, F.concat("sent", F.lit(" zzqx"))).otherwise(F.col("sent")).alias("excerpt"), F.when(k % 37 == 36, page + 1).alias("page_override"),
        F.when(~own, (doc % 9).cast("string")).alias("locator"), F.when(k % 41 == 5, "greek").alias("script"), F.when(figure, F.concat(F.lit("Figure "), k.cast("string"))).alias("caption"), F.when(k % 23 == 7, F.concat(F.lit("in other words: "), "sent")).alias("excerpt_translation"),
    )


def statements(evidence: DataFrame) -> DataFrame:
    """book_id, page_index, statement_id, k, type, basis, text, and refs (array of evidence ids in order)."""
    k = F.col("k")
    return evidence.where("source = 'body'").select(
        "book_id", "page_index", "doc_id", "k", F.concat(F.lit("s-"), k.cast("string")).alias("statement_id"), F.when((k * 13 + F.col("doc_id")) % 101 == 0, "remark").otherwise(pick(TYPES, k)).alias("type"), pick(BASES, k).alias("basis"), F.left("excerpt", F.lit(80)).alias("text"),
        F.when(k % 6 == 0, F.array("evidence_id", F.lit("e-f"))).otherwise(F.array("evidence_id")).alias("refs"),
    )


def references(statements: DataFrame) -> DataFrame:
    """A row for each reference of a statement, with its place."""
    return statements.select("book_id", "page_index", "statement_id", F.posexplode("refs").alias("pos", "evidence_id"))


def relations(statements: DataFrame) -> DataFrame:
    """book_id, page_index, pos, src, dst, rel_type: each statement and the one three sentences on, which may not exist."""
    k = F.col("k")
    return statements.select("book_id", "page_index", k.alias("pos"), F.col("statement_id").alias("src"), F.concat(F.lit("s-"), (k + 3).cast("string")).alias("dst"), pick(RELATIONS, k).alias("rel_type"))


def terms(statements: DataFrame) -> DataFrame:
    """book_id, page_index, pos, term_id, label: a term at every fifth sentence that gives a statement."""
    k = F.col("k")
    return statements.where(k % 5 == 0).select("book_id", "page_index", k.alias("pos"), F.concat(F.lit("t-"), k.cast("string")).alias("term_id"), F.concat(F.lit("term "), k.cast("string")).alias("label"))


def statement_terms(statements: DataFrame) -> DataFrame:
    """The term of the fifth sentence before a statement, which may not exist."""
    return statements.select("book_id", "page_index", "statement_id", F.lit(0).alias("pos"), F.concat(F.lit("t-"), (F.col("k") - F.col("k") % 5).cast("string")).alias("term_id"))


def term_relations(statements: DataFrame) -> DataFrame:
    """Relations of every fourth statement with that term."""
    k = F.col("k")
    return statements.where(k % 4 == 0).select("book_id", "page_index", k.alias("pos"), F.col("statement_id").alias("src"), F.concat(F.lit("t-"), (k - k % 5).cast("string")).alias("dst"), F.lit("elaborates").alias("rel_type"))


class Corpus:
    """The derived tables of one folder.

    With hold, tables that several branches of a query read (keep) are written to the shared folder the first time and
    read from there after that, so the texts are read, numbered and normalised once, however large the plan. streams:
    whether the page streams are among them; a query that reads them for the evidence alone needs no copy of the texts."""

    def __init__(self, spark: SparkSession, sf_dir: str, hold: bool = False, streams: bool = True):
        self.spark, self.sf_dir, self.hold, self.streams = spark, sf_dir, hold, streams
        self._kept: dict[str, DataFrame] = {}
        self._parts: int | None = None

    def keep(self, name: str, make: Callable[[], DataFrame] | None) -> DataFrame:
        if name not in self._kept:
            rows = make()
            self._kept[name] = written(rows, name) if self.hold else rows
        return self._kept[name]

    def has(self, name: str) -> bool:
        return name in self._kept

    def put(self, name: str, rows: DataFrame) -> None:
        self._kept[name] = rows

    @property
    def numbers(self) -> DataFrame:
        return self.keep("numbers", lambda: page_numbers(self.spark, self.sf_dir))

    @property
    def heads(self) -> DataFrame:
        return self.numbers.select("book_id", "page_index", top_line().alias("top_line"))

    @property
    def pages(self) -> DataFrame:
        return pages(self.numbers, documents(self.spark, self.sf_dir))

    @property
    def norm(self) -> DataFrame:
        return self.keep("norm", lambda: normalized_pages(self.pages)) if self.streams else normalized_pages(self.pages)

    @property
    def sents(self) -> DataFrame:
        return sentence_rows(self.norm)

    @property
    def evidence(self) -> DataFrame:
        return self.keep("evidence", lambda: evidence(self.norm))

    @property
    def statements(self) -> DataFrame:
        return statements(self.evidence)

    @property
    def references(self) -> DataFrame:
        return references(self.statements)

    @property
    def relations(self) -> DataFrame:
        return relations(self.statements)

    @property
    def terms(self) -> DataFrame:
        return terms(self.statements)

    @property
    def statement_terms(self) -> DataFrame:
        return statement_terms(self.statements)

    @property
    def all_relations(self) -> DataFrame:
        """The relations between statements, and those with terms."""
        return self.relations.unionByName(term_relations(self.statements))

    @property
    def parts(self) -> int:
        """Tasks for texts that become words within them: one for each 4 million characters, since words are some twenty times
        as large in memory; by the size of the texts alone the tasks would be too few."""
        if self._parts is None:
            chars = documents(self.spark, self.sf_dir).agg(F.sum(F.length("text"))).first()[0] or 0
            self._parts = max(self.spark.sparkContext.defaultParallelism, chars // PART_CHARS + 1)
        return self._parts

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
