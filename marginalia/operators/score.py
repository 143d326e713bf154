"""The floor score: counts per page, book and corpus, rates, provenance of runs and their comparison.

Counts are additive, so every level is one aggregation of the one below, with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.anchor import PAGE

COUNTS = ("statements_total", "statements_grounded", "excerpts_total", "excerpts_anchored", "referential_problems", "schema_problems")
BOOK_COUNTS = (*COUNTS, "pages_expected", "pages_present")


def floor_page(evidence: DataFrame, statements: DataFrame, referential: DataFrame, schema: DataFrame, untraced: DataFrame) -> DataFrame:
    """Counts of each page with notes. A statement is grounded if it names any evidence, whether that exists or not."""
    marks = ("statement", "grounded", "excerpt", "untraced", "referential", "schema")

    def tagged(rows: DataFrame, what: Column) -> DataFrame:
        return rows.select(*PAGE, what.alias("what"))

    rows = tagged(statements, F.lit("statement")).union(tagged(statements.where(F.size("refs") > 0), F.lit("grounded")))
    rows = rows.union(tagged(evidence.where(F.coalesce("kind", F.lit("text")) == "text"), F.lit("excerpt")))
    for name, part in (("untraced", untraced), ("referential", referential), ("schema", schema)):
        rows = rows.union(tagged(part, F.lit(name)))
    n = rows.groupBy(*PAGE).agg(*(F.count_if(F.col("what") == m).alias(m) for m in marks))
    return n.select(*PAGE, F.col("statement").alias("statements_total"), F.col("grounded").alias("statements_grounded"), F.col("excerpt").alias("excerpts_total"), F.greatest(F.col("excerpt") - F.col("untraced"), F.lit(0)).alias("excerpts_anchored"), F.col("referential").alias("referential_problems"), F.col("schema").alias("schema_problems"))


def floor_book(page_counts: DataFrame, present: DataFrame, expected: DataFrame) -> DataFrame:
    """Sums over each book's present pages, and its expected, present and missing pages.

    present: the pages whose notes could be read. expected: pages with `expected_notes` (null: no mark). A book of which
    no page has a mark expects the pages that it has. Lists are comma-joined page numbers in order."""
    marks = expected.select(*PAGE, "expected_notes")
    both = present.select(*PAGE, F.lit(True).alias("is_present")).join(marks, PAGE, "full").withColumn("is_present", F.coalesce("is_present", F.lit(False)))
    marked = F.max(F.col("expected_notes").isNotNull())
    pages = both.groupBy("book_id").agg(
        marked.alias("marked"),
        F.collect_list(F.when(F.col("expected_notes"), F.col("page_index"))).alias("wanted"),
        F.collect_list(F.when(F.col("is_present"), F.col("page_index"))).alias("had"),
    ).withColumn("wanted", F.when(F.col("marked"), F.col("wanted")).otherwise(F.col("had")))

    def listed(a: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(a), lambda i: i.cast("string")), ",")

    pages = pages.select(
        "book_id", F.size("wanted").cast("long").alias("pages_expected"), F.size(F.array_intersect("wanted", "had")).cast("long").alias("pages_present"),
        listed(F.col("wanted")).alias("expected_pages"), listed(F.col("had")).alias("present_pages"), listed(F.array_except("wanted", "had")).alias("missing_pages"),
    )
    sums = page_counts.join(present.select(*PAGE), PAGE, "left_semi").groupBy("book_id").agg(*(F.sum(c).alias(c) for c in COUNTS))
    return pages.join(sums, "book_id", "left").select("book_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), "pages_expected", "pages_present", "expected_pages", "present_pages", "missing_pages")


def rate(part: str, whole: str) -> Column:
    """Nothing to score reads as no failure."""
    return F.when(F.col(whole) == 0, F.lit(1.0)).otherwise(F.col(part).cast("double") / F.col(whole))


def rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"anchored_rate": rate("excerpts_anchored", "excerpts_total"), "grounded_rate": rate("statements_grounded", "statements_total"), "complete_rate": rate("pages_present", "pages_expected")})


def corpus_hash(books: DataFrame) -> DataFrame:
    """First 16 hex digits of SHA-256 over the sorted book names, one a line. The names are short; one row comes out."""
    return books.select("book_id").distinct().agg(F.left(F.sha2(F.array_join(F.sort_array(F.collect_list("book_id")), "\n"), 256), F.lit(16)).alias("corpus_hash"))


def floor_levels(books: DataFrame) -> DataFrame:
    """Counts and rates of each book and of the whole corpus (book_id null) from one aggregation."""
    counts = books.rollup("book_id").agg(F.grouping("book_id").alias("whole"), F.count("*").alias("books"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in BOOK_COUNTS))
    return rates(counts).drop("whole")


def floor_corpus(books: DataFrame) -> DataFrame:
    total = floor_levels(books).where("book_id is null").drop("book_id")
    return total.crossJoin(corpus_hash(books))


def generation_book(generation: DataFrame) -> DataFrame:
    """Per book: its one setting, or unknown (no page has one), or mixed; and the different settings.

    generation: a struct column of model, effort and max_tokens, null where a page has none; a struct of three nulls is
    a setting like any other."""
    text = F.when(F.col("generation").isNotNull(), F.concat_ws("|", *(F.coalesce(F.col(f"generation.{k}").cast("string"), F.lit("-")) for k in ("model", "effort", "max_tokens"))))
    g = generation.select("book_id", text.alias("setting")).groupBy("book_id").agg(F.sort_array(F.collect_set("setting")).alias("settings"), F.max(F.col("setting").isNull()).alias("some_unknown"))
    one = F.when(F.size("settings") == 0, "unknown").when((F.size("settings") == 1) & ~F.col("some_unknown"), F.element_at("settings", 1)).otherwise("mixed")
    shown = F.when(F.col("some_unknown"), F.array_append("settings", F.lit("unknown"))).otherwise(F.col("settings"))
    return g.select("book_id", one.alias("setting"), F.when(one == "mixed", F.array_join(shown, ",")).alias("distinct_settings"))


def generation_corpus(books: DataFrame) -> DataFrame:
    """The same one level up: one setting only if every book has it."""
    known = F.count_distinct(F.when(~F.col("setting").isin("unknown", "mixed"), F.col("setting")))
    mixed, unknown = F.count_if(F.col("setting") == "mixed"), F.count_if(F.col("setting") == "unknown")
    label = F.when((known == 0) & (mixed == 0), "unknown").when((known == 1) & (mixed == 0) & (unknown == 0), F.max("setting")).otherwise("mixed")
    return books.agg(F.count("*").alias("books"), mixed.alias("mixed_books"), unknown.alias("unknown_books"), label.alias("setting"))


def compare(runs: DataFrame) -> DataFrame:
    """Metrics by run, with the change from first to last. runs: run, place (order), the corpus counts; nulls stay null."""
    stacked = rates(runs).select(
        "place",
        F.expr("""stack(6, 'anchored rate', anchored_rate, cast(null as double), 'grounded rate', grounded_rate, null, 'complete rate', complete_rate, null,
            'excerpts', cast(excerpts_anchored as double), cast(excerpts_total as double), 'statements', cast(statements_grounded as double), cast(statements_total as double), 'pages', cast(pages_present as double), cast(pages_expected as double)) as (metric, value, whole)"""),
    )
    return stacked.groupBy("metric").agg(F.min_by("value", "place").alias("first_value"), F.min_by("whole", "place").alias("first_whole"), F.max_by("value", "place").alias("last_value"), F.max_by("whole", "place").alias("last_whole")).withColumn("delta", F.col("last_value") - F.col("first_value"))


def comparability(runs: DataFrame) -> DataFrame:
    """Whether all runs have one corpus hash (a run without one counts as '?'), and which aren't clean."""
    unfinished = F.col("pages_present") < F.col("pages_expected")
    return runs.agg((F.count_distinct(F.coalesce("corpus_hash", F.lit("?"))) == 1).alias("comparable"), F.count_if(unfinished).alias("incomplete_runs"), F.count_if(F.col("setting") == "mixed").alias("mixed_runs"))


def valid_artifacts(artifacts: DataFrame, kind: str = "floor-score", version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows of the right kind and version, and the rest with a reason."""
    right = F.coalesce((F.col("kind") == kind) & (F.col("schema_version") == version), F.lit(False))
    reason = F.when(F.coalesce(F.col("kind") != kind, F.lit(True)), "kind").otherwise("schema_version")
    return artifacts.where(right), artifacts.where(~right).withColumn("reason", reason)
