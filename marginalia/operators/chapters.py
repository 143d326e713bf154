"""Chapters from running headers: titles, forward-filled sections, runs and strays, stitches across pages.

All of it works on the top lines (one short string a page); a page's text is only read to stitch. A book may have any
number of pages and chapters: running numbers and fills are two-level scans, neighbours meet by number, and the rule that runs
from left to right is cut where a chapter certainly starts, so no task gets a whole book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import scan
from marginalia.operators.anchor import PAGE


BOOK = ["book_id"]


def running_headers(heads: DataFrame) -> DataFrame:
    """Top lines of a book that repeat or look like a header."""
    return heads.where("top_line <> ''").groupBy("book_id", "top_line").agg(F.count("*").alias("n"), F.min("page_index").alias("first_page")).where((F.col("n") >= 2) | T.looks_like_header(F.col("top_line")))


def book_title(heads: DataFrame) -> DataFrame:
    """The most frequent top line; of equally frequent ones the first seen (so a lone first header is the title)."""
    n = heads.where("top_line <> ''").groupBy("book_id", "top_line").agg(F.count("*").alias("n"), F.min("page_index").alias("first_page"))
    return n.groupBy("book_id").agg(F.max_by("top_line", F.struct("n", -F.col("first_page"))).alias("title"))


def grouped(heads: DataFrame) -> DataFrame:
    """heads with header (the despaced top line where it heads a section), chapter_no (from 1) and chapter_key."""
    known = running_headers(heads).select("book_id", "top_line", F.lit(True).alias("is_header"))
    marked = scan.placed(heads.select(*PAGE, "top_line"), BOOK, ["page_index"]).join(known, ["book_id", "top_line"], "left").join(book_title(heads), "book_id", "left")
    heading = F.col("is_header") & (F.col("top_line") != F.col("title"))
    marked = marked.select(*PAGE, scan.PART, F.when(heading, T.despaced(F.col("top_line"))).alias("header"), F.when(heading, T.section_key(F.col("top_line"))).alias("own_key"))
    filled = scan.carried(marked, BOOK, ["page_index"], "own_key", "chapter_key").withColumn("chapter_key", F.coalesce("chapter_key", F.lit("FRONT-MATTER")))
    compared = scan.previous(filled.select(*PAGE, scan.PART, "header", "chapter_key"), BOOK, ["page_index"], "chapter_key", "before")
    new = compared.withColumn("new", F.when(F.col("before").isNull() | (F.col("before") != F.col("chapter_key")), 1).otherwise(0))
    return scan.totalled(new, BOOK, ["page_index"], "new", "chapter_no").drop("new", "before", scan.PART)


def chapters(groups: DataFrame) -> DataFrame:
    """One row a chapter: key, title (the most telling header: with a colon, then longer, then earlier), pages in order."""
    best = F.max_by("header", F.when(F.col("header").isNotNull(), F.struct(F.contains("header", F.lit(":")), F.length("header"), -F.col("page_index"))))
    return groups.groupBy("book_id", "chapter_no", "chapter_key").agg(F.coalesce(best, F.lit("Front matter")).alias("title"), F.sort_array(F.collect_list("page_index")).alias("pages"))


def _beside(rows: DataFrame, steps: int, column: str, name: str) -> DataFrame:
    """rows with a column of the row so many numbers (at) further on in the book."""
    return rows.join(rows.select("book_id", (F.col("at") - steps).alias("at"), F.col(column).alias(name)), ["book_id", "at"], "left")


def merged_oscillating(chapters: DataFrame, least_run: int = 3) -> DataFrame:
    """From left to right, the longest run over at most two keys becomes one chapter if it has both and is long enough (3 or
    more).

    Neighbours have different keys (as grouped() makes them), so a run from a chapter goes on while each key equals the one
    two places before. Which runs are taken depends on where the one before ended, but where neither a chapter nor the next
    one has the key two places before, no run of three reaches over its start: it starts anew there. Between two such
    starts, which lie as far apart as keys oscillate, a fold over run ends (two numbers a chapter) picks the starts. The lead
    is the first chapter with a colon in its key, else the first of those with most pages."""
    at = scan.numbered(scan.placed(chapters.select("book_id", "chapter_no", "chapter_key", "title", "pages"), BOOK, ["chapter_no"]), BOOK, ["chapter_no"], "at")
    keys = at.select("book_id", "at", "chapter_key")
    broken = _beside(keys, -2, "chapter_key", "before").withColumn("broken", F.col("before").isNotNull() & (F.col("chapter_key") != F.col("before")))
    sure = _beside(broken.select("book_id", "at", "broken"), 1, "broken", "next_broken").withColumn("sure", (((F.col("at") <= 2) | F.col("broken")) & F.coalesce("next_broken", F.lit(True)) | (F.col("at") == 1)).cast("int"))
    parts = scan.totalled(at.join(sure.select("book_id", "at", "broken", "sure"), ["book_id", "at"]), BOOK, ["at"], "sure", "stretch")
    stretch = Window.partitionBy("book_id", "stretch")
    ends = parts.withColumn("last", F.coalesce(F.min(F.when(F.col("broken"), F.col("at"))).over(stretch.orderBy("at").rowsBetween(2, Window.unboundedFollowing)) - 1, F.max("at").over(stretch)))

    def step(done, x):
        run = F.when(x["last"] - x["at"] + 1 >= least_run, x["last"]).otherwise(x["at"])
        return F.when(x["at"] < done["free"], done).otherwise(F.struct(F.array_append(done["starts"], x["at"]).alias("starts"), (run + 1).cast("long").alias("free")))

    runs = ends.groupBy("book_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("at", F.col("last").cast("long").alias("last")))).alias("runs"))
    none = F.struct(F.array().cast("array<bigint>").alias("starts"), F.lit(0).cast("long").alias("free"))
    starts = runs.select("book_id", F.explode(F.aggregate("runs", none, step, lambda done: done["starts"])).alias("at"), F.lit(1).alias("start"))
    marked = scan.totalled(at.join(starts, ["book_id", "at"], "left").drop("chapter_no"), BOOK, ["at"], "start", "chapter_no")
    colon = F.when(F.contains("chapter_key", F.lit(":")), 0).otherwise(1)
    lead = F.struct(colon, F.when(colon == 0, 0).otherwise(-F.size("pages")), "at")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "pages"))), lambda c: c["pages"]))
    return marked.groupBy("book_id", "chapter_no").agg(F.min_by("chapter_key", lead).alias("chapter_key"), F.min_by("title", lead).alias("title"), whole.alias("pages"))


#: Fixed patterns: keys that head a chapter or part, an entry of a contents page, and what follows a name in it.
HEADED = r"^(CHAPTER \d+|PART )"
CONTENTS_ENTRY = r"CHAPTER\s+(\d+)\s+([A-Z][A-Za-z].*)"
LEADERS = r"[\s.·…]+\d+\s*$"


def absorbed_strays(chapters: DataFrame) -> DataFrame:
    """A section of at most two pages between two reference sections joins the section put out before it."""
    at = scan.numbered(scan.placed(chapters, BOOK, ["chapter_no"]), BOOK, ["chapter_no"], "at").withColumn("own", T.is_reference(F.col("title")))
    beside = _beside(_beside(at.select("book_id", "at", "own"), -1, "own", "before"), 1, "own", "after").select("book_id", "at", "before", "after")
    stray = F.coalesce((F.size("pages") <= 2) & ~F.col("chapter_key").rlike(HEADED) & ~F.col("own") & F.col("before") & F.col("after"), F.lit(False))
    marked = at.join(beside, ["book_id", "at"]).withColumn("stray", stray).withColumn("kept", F.when(F.col("stray"), 0).otherwise(1))
    target = scan.totalled(marked, BOOK, ["chapter_no"], "kept", "target")
    lead = F.struct(F.col("stray").cast("int"), "chapter_no")
    return target.groupBy("book_id", "target").agg(F.min_by("chapter_key", lead).alias("chapter_key"), F.min_by("title", lead).alias("title"), F.sort_array(F.flatten(F.collect_list("pages"))).alias("pages")).withColumnRenamed("target", "chapter_no")


def titled_from_contents(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Bare 'CHAPTER n' titles get the name that a contents page gives: the first one, up to a colon, without dots and page."""
    listed = chapters.where(F.contains(F.upper("title"), F.lit("CONTENTS"))).select("book_id", F.explode("pages").alias("page_index"))
    lines = pages.join(listed, PAGE).select(*PAGE, F.posexplode(F.split(F.concat_ws("\n", "body", "footnotes"), "\n")).alias("line_no", "line"))
    name = F.trim(F.regexp_replace(F.split_part(F.regexp_extract("line", CONTENTS_ENTRY, 2), F.lit(":"), F.lit(1)), LEADERS, ""))
    names = lines.select("book_id", F.regexp_extract("line", CONTENTS_ENTRY, 1).alias("number"), name.alias("name"), F.struct("page_index", "line_no").alias("place")).where("number <> '' and name <> ''").groupBy("book_id", "number").agg(F.min_by("name", "place").alias("name"))
    bare = chapters.withColumn("number", F.regexp_extract(F.trim("title"), r"^CHAPTER (\d+)$", 1))
    return bare.join(names, ["book_id", "number"], "left").withColumn("title", F.when(F.col("name").isNotNull(), F.concat(F.lit("CHAPTER "), F.col("number"), F.lit(": "), F.col("name"))).otherwise(F.col("title"))).drop("number", "name")


def page_sections(chapters: DataFrame) -> DataFrame:
    return chapters.select("book_id", F.explode("pages").alias("page_index"), "chapter_no", "title", T.is_prose(F.col("title")).alias("prose"))


def summaries(chapters: DataFrame, statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pages of each chapter, how many have notes, and their statements and evidence."""
    noted = statements.groupBy(*PAGE).agg(F.count("*").alias("s")).join(evidence.groupBy(*PAGE).agg(F.count("*").alias("e")), PAGE, "full")
    rows = chapters.select("book_id", "chapter_no", "chapter_key", "title", F.explode("pages").alias("page_index")).join(noted, PAGE, "left")
    return rows.groupBy("book_id", "chapter_no", "chapter_key", "title").agg(F.count("*").alias("pages"), F.count_if(F.coalesce("s", "e").isNotNull()).alias("with_notes"), F.coalesce(F.sum("s"), F.lit(0)).alias("statements"), F.coalesce(F.sum("e"), F.lit(0)).alias("evidence"))


def stitches(evidence: DataFrame, pages: DataFrame, norm: DataFrame) -> DataFrame:
    """Body quotes cut off at the end of a text page, completed from the head of the next page, if that is text too.

    Pages meet by page_index + 1, so a missing page is never skipped over. The suffix is tested on normalised text, the
    completed quote is made of the texts as they are."""
    cut = evidence.where((F.col("source") == "body") & T.ends_open(F.col("excerpt"))).select(*PAGE, "evidence_id", "excerpt")
    this = norm.where("page_type = 'text'").select(*PAGE, "body_norm")
    following = pages.where("page_type = 'text'").select("book_id", (F.col("page_index") - 1).alias("page_index"), T.completion(F.col("body")).alias("completion"))
    met = cut.join(this, PAGE).where(F.endswith("body_norm", T.normalized(F.col("excerpt")))).join(following, PAGE).where("completion <> ''")
    return met.select(*PAGE, (F.col("page_index") + 1).alias("next_page_index"), "evidence_id", F.col("excerpt").alias("tail"), F.concat(F.rtrim("excerpt"), F.lit(" "), "completion").alias("stitched"))
