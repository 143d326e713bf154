"""Tables for the study document: citations, sources, contents, digests, translations and request batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T

CHAPTER = ["book_id", "chapter_no"]


def citation_audit(texts: DataFrame, known: DataFrame) -> DataFrame:
    """texts: keys..., text. known: keys..., statement_id. A row for each id that a text names, and whether it exists."""
    keys = [c for c in texts.columns if c != "text"]
    ids = texts.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({T.STATEMENT_ID})"), 1))).alias("statement_id"))
    return ids.join(known.select(*keys, "statement_id").distinct().withColumn("there", F.lit(True)), [*keys, "statement_id"], "left").withColumn("cited", F.coalesce("there", F.lit(False))).drop("there")


def appendix(cited: DataFrame, finals: DataFrame, records: DataFrame, uses: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """A line for each cited statement, and after it one for each of its evidence: quote, page, note number and source, and
    the quote's translation where it has one.

    cited: book_id, chapter_no, final_no. uses: the same and evidence, an array of evidence numbers. words: word, shown (translated labels; others stay). Statements go by
    the length of their id and then the id, which is their number."""
    show = finals.join(cited, [*CHAPTER, "final_no"], "left_semi")
    if words is not None:
        show = show.join(words.select(F.col("word").alias("type"), "shown"), "type", "left").withColumn("type", F.coalesce("shown", "type")).drop("shown")
    head = show.select(*CHAPTER, "final_no", F.lit(0).alias("line_no"), F.concat(F.lit("[s-"), "final_no", F.lit("] "), "type", F.coalesce(F.concat(F.lit(", "), "basis"), F.lit("")), F.lit(": "), "text").alias("line"))
    quote = F.when(F.length("excerpt") > 240, F.concat(F.left("excerpt", F.lit(237)), F.lit("…"))).otherwise(F.col("excerpt"))
    page = F.coalesce("page_label", F.concat(F.lit("idx"), F.col("page_index").cast("string")))
    note = F.coalesce(F.concat(F.lit(", fn "), F.nullif("locator", F.lit(""))), F.lit(""))
    gloss = F.coalesce(F.concat(F.lit(" — "), F.nullif("excerpt_translation", F.lit(""))), F.lit("")) if "excerpt_translation" in records.columns else F.lit("")
    each = uses.join(cited, [*CHAPTER, "final_no"], "left_semi").select(*CHAPTER, "final_no", F.posexplode("evidence").alias("pos", "evidence_no")).join(records, [*CHAPTER, "evidence_no"])
    lines = each.select(*CHAPTER, "final_no", (F.col("pos") + 1).alias("line_no"), F.concat(quote, F.lit(" — p. "), page, note, F.lit(" ("), "source", F.lit(")"), gloss).alias("line"))
    return head.unionByName(lines)


#: Fixed patterns: a heading of level 2 or 3, and the number that it may begin with.
HEADING, LEADING_NUMBER = r"^(#{2,3})\s+(.*)$", r"^\d+(\.\d+)*\.?\s+"


def toc(texts: DataFrame) -> DataFrame:
    """Numbered headings: level 2 as 1, 2, ..., level 3 as 1.1 (0.1 before any level 2), with anchors.

    texts: keys..., text. Lines of a text are numbered by running counts over its own headings alone."""
    keys = [c for c in texts.columns if c != "text"]
    lines = texts.select(*keys, F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    head = lines.withColumn("hashes", F.regexp_extract("line", HEADING, 1)).where("hashes <> ''")
    bare = F.regexp_replace(F.trim(F.regexp_extract("line", HEADING, 2)), LEADING_NUMBER, "")
    title = F.trim(F.regexp_replace(bare, rf"\[[^\]\n]*{T.STATEMENT_ID}[^\]\n]*\]", ""))
    order = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.when(F.col("hashes") == "##", 1).otherwise(0)
    c1 = head.withColumn("title", title).withColumn("c1", F.sum(first).over(order))
    inner = Window.partitionBy(*keys, "c1").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    c2 = c1.withColumn("c2", F.sum(1 - first).over(inner))
    main = F.col("hashes") == "##"
    return c2.select(*keys, "line_no", F.when(main, 1).otherwise(2).alias("level"), F.when(main, F.col("c1").cast("string")).otherwise(F.concat_ws(".", "c1", "c2")).alias("number"), "title", F.when(main, F.concat(F.lit("sec-"), "c1")).otherwise(F.concat_ws("-", F.lit("sec"), "c1", "c2")).alias("anchor"))


def book_toc(chapters: DataFrame, contents: DataFrame) -> DataFrame:
    """chapters: book_id, file_no, title. contents: toc() of each (book_id, file_no). Chapters are numbered in order, their
    headings under them, and anchors carry the chapter's file number."""
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("file_no"))
    numbered = chapters.select("book_id", "file_no", "title", n.alias("n"))
    prefix = F.format_string("c%03d", "file_no")
    top = numbered.select("book_id", "file_no", F.lit(-1).alias("line_no"), F.lit(0).alias("level"), F.col("n").cast("string").alias("number"), "title", F.concat(prefix, F.lit("-chap")).alias("anchor"))
    rest = contents.join(numbered.select("book_id", "file_no", "n"), ["book_id", "file_no"]).select("book_id", "file_no", "line_no", "level", F.concat_ws(".", "n", "number").alias("number"), "title", F.concat_ws("-", prefix, "anchor").alias("anchor"))
    return top.unionByName(rest)


def digest(finals: DataFrame, terms: DataFrame, relations: DataFrame) -> DataFrame:
    """One text a chapter: its statements by number with their terms, then its relations. terms: ..., final_no, labels (array)."""
    named = finals.join(terms, [*CHAPTER, "final_no"], "left")
    tail = F.when(F.size("labels") > 0, F.concat(F.lit(" {"), F.array_join("labels", ", "), F.lit("}"))).otherwise("")
    line = F.concat(F.lit("[s-"), "final_no", F.lit("] ("), "type", F.coalesce(F.concat(F.lit("/"), "basis"), F.lit("")), F.lit(") "), "text", tail)
    body = named.groupBy(*CHAPTER).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    edge = F.struct("rel_no", "src_no", "dst_no", "rel_type")
    links = relations.groupBy(*CHAPTER).agg(F.array_join(F.transform(F.array_sort(F.collect_list(edge)), lambda r: F.concat(F.lit("s-"), r["src_no"], F.lit(" "), r["rel_type"], F.lit(" s-"), r["dst_no"])), "; ").alias("links"))
    return body.join(links, CHAPTER, "left").select(*CHAPTER, F.concat("body", F.coalesce(F.concat(F.lit("\n\nRELATIONS: "), "links"), F.lit(""))).alias("digest"))


def translation_coverage(asked: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: how many were asked for and how many came back unusable. A result counts if it isn't blank or unchanged.

    asked: keys..., item, text. results: keys..., item, translation."""
    met = asked.join(results, [*keys, "item"], "left")
    good = F.coalesce((F.trim("translation") != "") & (F.trim("translation") != F.trim("text")), F.lit(False))
    return met.groupBy(*keys).agg(F.count("*").alias("asked"), F.count_if(good).alias("kept"), F.count_if(~good).alias("missing"))


def request_batches(items: DataFrame, keys: list[str], size: int = 25) -> DataFrame:
    """items: keys..., item. A batch number for each, by item within its group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("item"))
    return items.withColumn("batch", F.ceil(place / size).cast("long"))


def retry_batches(items: DataFrame, done: DataFrame, keys: list[str], size: int, floor: int = 5) -> DataFrame:
    """What is still missing, in batches of half the size, but not under the floor."""
    return request_batches(items.join(done, [*keys, "item"], "left_anti"), keys, max(floor, size // 2))


def book_chapters(exports: DataFrame, notes: DataFrame, style: str, language: str) -> DataFrame:
    """The exports (book_id, file_no, style, language, text) of one style and language with their titles.

    The title is that of the notes, else the chapter's key, else the text's first level-1 heading; where there is none,
    a placeholder. Reference sections go only where the title is known."""
    mine = exports.where((F.col("style") == style) & (F.col("language") == language)).join(notes.select("book_id", "file_no", F.col("title").alias("notes_title"), "chapter_key"), ["book_id", "file_no"], "left")
    title = F.coalesce(F.nullif("notes_title", F.lit("")), F.nullif("chapter_key", F.lit("")), F.nullif(F.regexp_extract("text", r"(?m)^# (.+)$", 1), F.lit("")))
    return mine.withColumn("title", title).where(F.col("title").isNull() | T.is_prose(F.col("title"))).withColumn("title", F.coalesce("title", F.concat(F.lit("Chapter "), F.col("file_no").cast("string")))).select("book_id", "file_no", "title", "text")
