"""From pages to proposals and from proposals to canonical notes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators import scan
from marginalia.operators.anchor import PAGE


def page_context(pages: DataFrame, selected: DataFrame, window: int = 1) -> DataFrame:
    """Neighbours of each selected page: text pages at most `window` places away among the book's pages."""
    rows = scan.placed(pages.select(*PAGE, "page_type"), ["book_id"], ["page_index"])
    placed = scan.numbered(rows, ["book_id"], ["page_index"], "place").drop(scan.PART)
    mine = placed.join(selected.select(*PAGE), PAGE, "left_semi").select("book_id", "page_index", F.explode(F.array(*(F.col("place") + d for d in range(-window, window + 1) if d))).alias("place"))
    return mine.join(placed.where("page_type = 'text'").select("book_id", "place", F.col("page_index").alias("context_index")), ["book_id", "place"]).select(*PAGE, "context_index")


def worklist(pages: DataFrame, done: DataFrame, chosen: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Pages to extract: all text pages, or of the chosen ones those of text and figures; less what is done, unless forced."""
    picked = pages.where("page_type = 'text'") if chosen is None else pages.where(F.col("page_type").isin("text", "figure")).join(chosen.select(*PAGE), PAGE, "left_semi")
    return picked.select(*PAGE) if force else picked.select(*PAGE).join(done.select(*PAGE), PAGE, "left_anti")


def propose(pages: DataFrame, extractor: Callable[[dict], dict], partitions: int | None = None) -> DataFrame:
    """Calls a function for each page (a dict of its columns) and keeps its answer as JSON; one page's failure is a row
    with its error, and the rest goes on. `partitions` bounds how many calls run at once."""

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for page in part.to_dict("records"):
                try:
                    rows.append((page["book_id"], page["page_index"], "ok", json.dumps(extractor(page)), None))
                except Exception as e:  # a page's failure is data here
                    rows.append((page["book_id"], page["page_index"], "failed", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["book_id", "page_index", "status", "proposal", "error"])

    return (pages.repartition(partitions) if partitions else pages).mapInPandas(task, "book_id string, page_index long, status string, proposal string, error string")


PROPOSAL = """terms array<struct<label:string>>, statements array<struct<key:string, type:string, basis:string, text:string, terms:array<string>,
    evidence:array<struct<excerpt:string, source:string, locator:string, script:string>>>>, relations array<struct<`from`:string, `to`:string, type:string>>, detected_language string"""


def parsed(proposals: DataFrame) -> DataFrame:
    return proposals.where("status = 'ok'").select(*PAGE, F.from_json("proposal", PROPOSAL).alias("p"))


def canonical_statements(proposals: DataFrame) -> DataFrame:
    """s-1, s-2, ... in order, text trimmed, defaults filled in; basis 'author' and blank become null. labels: its terms."""
    rows = proposals.select(*PAGE, F.posexplode("p.statements").alias("n", "s"))
    return rows.select(*PAGE, F.concat(F.lit("s-"), (F.col("n") + 1).cast("string")).alias("statement_id"), "n", F.coalesce("s.key", F.concat(F.lit("s-"), (F.col("n") + 1).cast("string"))).alias("key"), F.coalesce("s.type", F.lit("claim")).alias("type"), F.nullif(F.nullif("s.basis", F.lit("author")), F.lit("")).alias("basis"), F.trim(F.coalesce("s.text", F.lit(""))).alias("text"), F.filter(F.coalesce("s.terms", F.array().cast("array<string>")), lambda t: F.trim(t) != "").alias("labels"), "s.evidence")


def canonical_evidence(statements: DataFrame) -> DataFrame:
    """e-1, e-2, ... over a page's statements in order, with the statement that cites each; script 'latin' is left out."""
    rows = statements.select(*PAGE, "n", "statement_id", F.posexplode("evidence").alias("pos", "e"))
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("n", "pos"))
    return rows.select(*PAGE, "statement_id", "pos", F.concat(F.lit("e-"), number.cast("string")).alias("evidence_id"), F.lit("text").alias("kind"), F.coalesce("e.excerpt", F.lit("")).alias("excerpt"), F.coalesce("e.source", F.lit("body")).alias("source"), F.nullif("e.locator", F.lit("")).alias("locator"), F.nullif(F.nullif("e.script", F.lit("latin")), F.lit("")).alias("script"))


def canonical_terms(proposals: DataFrame, statements: DataFrame) -> DataFrame:
    """Terms by first mention (the list, then the statements), with ids from their labels.

    A label whose id is taken gets the number of terms before it added; an id may in turn be one that such a number
    made, so a page's labels are gone through in order (they are few)."""
    listed = proposals.select(*PAGE, F.posexplode("p.terms").alias("pos", "t")).select(*PAGE, F.lit(-1).alias("n"), "pos", F.trim("t.label").alias("label"))
    named = statements.select(*PAGE, "n", F.posexplode("labels").alias("pos", "label")).select(*PAGE, "n", "pos", F.trim("label").alias("label"))
    first = listed.unionByName(named).where("label <> ''").groupBy(*PAGE, "label").agg(F.min(F.struct("n", "pos")).alias("at"))
    bare = F.regexp_replace(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slugs = first.withColumn("slug", F.concat(F.lit("t-"), F.when(bare == "", "x").otherwise(bare)))
    lists = slugs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("at", "label", "slug"))).alias("labels"))
    none = F.array().cast("array<struct<term_id:string,label:string,place:int>>")

    def step(done, x):
        taken = F.exists(done, lambda d: d["term_id"] == x["slug"])
        own = F.when(taken, F.concat_ws("-", x["slug"], F.size(done).cast("string"))).otherwise(x["slug"])
        return F.array_append(done, F.struct(own.alias("term_id"), x["label"].alias("label"), F.size(done).alias("place")))

    return lists.select(*PAGE, F.explode(F.aggregate("labels", none, step)).alias("t")).select(*PAGE, "t.term_id", "t.label", "t.place")


def canonical_relations(proposals: DataFrame, statements: DataFrame, terms: DataFrame) -> DataFrame:
    """Ends are statement keys, or else term labels; edges with an end that is neither, or without a type, go."""
    rows = proposals.select(*PAGE, F.posexplode("p.relations").alias("place", "r")).where(F.coalesce("r.type", F.lit("")) != "")
    keys = statements.groupBy(*PAGE, "key").agg(F.max_by("statement_id", "n").alias("s_id"))
    out = rows.select(*PAGE, "place", F.col("r.from").alias("a"), F.col("r.to").alias("b"), F.col("r.type").alias("rel_type"))
    for end, name in (("a", "src"), ("b", "dst")):
        out = out.join(keys.select(*PAGE, F.col("key").alias(end), "s_id"), [*PAGE, end], "left").withColumn("label", F.trim(F.coalesce(end, F.lit(""))))
        out = out.join(terms.select(*PAGE, "label", "term_id"), [*PAGE, "label"], "left").withColumn(name, F.coalesce("s_id", "term_id")).drop("s_id", "term_id", "label")
    return out.where("src is not null and dst is not null").select(*PAGE, "src", "dst", "rel_type", "place")


def stamped(notes: DataFrame, pages: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """notes (book_id, page_index, ...) with source columns from the page, whatever the proposal said, and the run's
    settings (book_id, page_index, generation) where they are known."""
    own = [c for c in notes.columns if c not in ("scope", "page_label", "doc_id")]
    out = notes.select(*own).join(pages.select(*PAGE, "doc_id", "page_label"), PAGE).withColumn("scope", F.lit("page"))
    return out.join(settings.select(*PAGE, "generation"), PAGE, "left") if settings is not None else out


def roll_up_language(pages: DataFrame) -> DataFrame:
    """Per book: the one language its pages agree on (case and blanks aside), unknown if none says, else mixed."""
    said = F.nullif(F.lower(F.trim("language")), F.lit(""))
    return pages.groupBy("book_id").agg(F.when(F.count_distinct(said) == 0, "unknown").when(F.count_distinct(said) == 1, F.max(said)).otherwise("mixed").alias("language"))


def translation_decision(books: DataFrame, target: str, explicit: bool = False, decided: DataFrame | None = None) -> DataFrame:
    """native or the target language for each book. Asked for outright, it is the target; a book of the target language,
    or of none that is known, stays native; the rest follows the user's table (book_id, translate), else native."""
    out = books.join(decided.select("book_id", "translate"), "book_id", "left") if decided is not None else books.withColumn("translate", F.lit(None).cast("boolean"))
    same = F.lower("language") == target.lower()
    choice = F.when(same, "native").when(F.lit(explicit), target).when(F.col("language").isin("unknown", "mixed"), "native").when(F.coalesce("translate", F.lit(False)), target).otherwise("native")
    return out.select("book_id", "language", choice.alias("reading"))
