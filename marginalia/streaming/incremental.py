"""Incremental runs: fingerprints that tell what to recompute, and the gate as a stream over arriving notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators import anchor, score, validate
from marginalia.sources import page_store
from marginalia.sources.notes import PAGE, flattened, items, parsed_notes


def fingerprints(pages: DataFrame, options: str = "") -> DataFrame:
    """book_id and a hash over its pages' contents, in order, and the options of the run; pages: ..., text, footnotes."""
    own = F.sha2(F.concat_ws("\x1f", F.col("page_index").cast("string"), F.coalesce("text", F.lit("")), F.coalesce("footnotes", F.lit(""))), 256)
    hashes = pages.select("book_id", "page_index", own.alias("h")).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "h"))).alias("hs"))
    return hashes.select("book_id", F.sha2(F.concat(F.array_join(F.transform("hs", lambda x: x["h"]), ""), F.lit(f"\x1e{options}")), 256).alias("fingerprint"))


def changed(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Books whose fingerprint isn't stored."""
    return now.join(stored.select("book_id", "fingerprint"), ["book_id", "fingerprint"], "left_anti")


RAW = "book_id string, page_index long, raw string"


def arriving_notes(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Notes-sets (book_id, page_index, raw JSON) as Parquet or JSON-lines files that arrive in a folder."""
    reader = spark.readStream.schema(RAW)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(folder)


def gate_stream(arriving: DataFrame, norm: DataFrame, sink: str, checkpoint: str, then: Callable[[dict[str, DataFrame]], None] | None = None) -> StreamingQuery:
    """Gates each micro-batch against the static page streams and appends what survives and the audit to folders of `sink`.

    A page that the sink already has is not replaced: the batch is anti-joined to the manifest of finished pages, of which
    only the batch's buckets are read, so no state grows with the stream. Of several notes-sets of a page in one batch the
    least by content is taken. Notes are parsed once, and each table is made from those that the batch has written, so quotes are
    looked up once. A batch that is run again after a failure writes its own folders (by batch number) anew, so
    nothing is written twice."""
    spark = norm.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        first = batch.groupBy(*PAGE).agg(F.min("raw").alias("raw"))
        fresh = parsed_notes(page_store.unfinished(first, sink, before=number)).persist()
        try:
            flat = flattened(fresh)
            out = {}

            def put(name: str, rows: DataFrame) -> DataFrame:
                rows.write.mode("overwrite").parquet(f"{sink}/{name}/batch={number}")
                out[name] = spark.read.schema(rows.schema).parquet(f"{sink}/{name}/batch={number}")
                return out[name]

            flagged = put("evidence", anchor.anchored(flat["evidence"], norm))
            kept = put("statements", anchor.pruned(flat["statements"], anchor.kept_references(flat["references"], flagged)))
            put("relations", anchor.surviving_relations(kept, flat["relations"], flat["statement_terms"]))
            put("dropped", anchor.dropped(flagged, flat["statements"], flat["references"]))
            page_store.put(fresh.select(*PAGE), sink, number)
            if then:
                then(out)
        finally:
            fresh.unpersist()

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def floor_stream(arriving: DataFrame, norm: DataFrame, store: str, checkpoint: str, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Keeps each page's floor counts in a page store as notes arrive: anchored quotes, problems of references and of schema.

    A notes-set is counted against the static page streams when it arrives. A later one of the same page replaces its
    counts, so a correction may lower them; unreadable ones count as no notes. then: called with each batch's number."""

    def one(batch: DataFrame, number: int) -> None:
        fresh = parsed_notes(batch.groupBy(*PAGE).agg(F.min("raw").alias("raw"))).persist()
        try:
            page_store.put(page_counts(fresh, norm), store, number)
            if then:
                then(number)
        finally:
            fresh.unpersist()

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_counts(notes: DataFrame, norm: DataFrame) -> DataFrame:
    """The floor counts of each page with notes, and whether they could be read: what score.floor_page gives of the flat tables.

    Notes that are dealt by page already are counted where they are; only the quotes are shuffled, to the pages they cite."""
    rows = items(notes)
    what, excerpt = F.col("what"), (F.col("what") == "evidence") & (F.col("kind") == "text")
    own = rows.groupBy(*PAGE).agg(
        F.count_if(what == "statements").alias("statements_total"), F.count_if((what == "statements") & (F.size("refs") > 0)).alias("statements_grounded"), F.count_if(excerpt).alias("excerpts_total"), F.sum(validate.schema_count()).alias("schema_problems"),
    )
    quotes = rows.where(excerpt).select(*PAGE, "evidence_id", "kind", "source", "excerpt", "page_override")
    untraced = validate.traceability(quotes, norm).groupBy(*PAGE).agg(F.count("*").alias("untraced"))
    found = notes.select(*PAGE, "readable").join(own, PAGE, "left").join(validate.reference_count(notes.where("readable")), PAGE, "left").join(untraced, PAGE, "left")
    anchored = F.greatest(F.col("excerpts_total") - F.coalesce("untraced", F.lit(0)), F.lit(0))
    counts = found.withColumns({"excerpts_anchored": anchored, "referential_problems": F.col("loose")})
    return counts.select(*PAGE, "readable", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in score.COUNTS))


def running_floor(spark: SparkSession, store: str, expected: DataFrame) -> DataFrame:
    """The floor of each book from what the store has now."""
    kind = {"book_id": "string", "page_index": "bigint", "readable": "boolean"} | dict.fromkeys(score.COUNTS, "bigint")
    rows = page_store.current(spark, store, T.StructType.fromDDL(", ".join(f"{c} {k}" for c, k in kind.items()))).where("readable")
    return score.floor_book(rows.drop("readable"), rows.select(*PAGE), expected)


def running_counts(arriving: DataFrame) -> DataFrame:
    """Streaming floor counts per book as notes arrive (update or complete mode): statements and how many name evidence, text
    excerpts, references to evidence that the notes don't have, and notes that can't be read.

    All of them are sums over one notes-set, so the state is a few numbers a book."""
    rows = parsed_notes(arriving)
    statements, evidence = (F.coalesce(f"notes.{c}", F.lit(None)) for c in ("statements", "evidence"))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    grounded = size(F.filter(statements, lambda s: F.coalesce(F.size(s["evidence"]) > 0, F.lit(False))))
    excerpts = size(F.filter(evidence, lambda e: F.coalesce(e["kind"], F.lit("text")) == "text"))
    known = F.coalesce(F.transform(evidence, lambda e: e["id"]), F.array().cast("array<string>"))
    cited = F.flatten(F.transform(statements, lambda s: F.coalesce(s["evidence"], F.array().cast("array<string>"))))
    loose = size(F.filter(cited, lambda i: ~F.array_contains(known, i)))
    seen = lambda n: F.sum(F.when(F.col("readable"), n).otherwise(0))
    return rows.groupBy("book_id").agg(
        seen(size(statements)).alias("statements"), seen(grounded).alias("grounded"), seen(size(evidence)).alias("evidence"), seen(excerpts).alias("excerpts"), seen(loose).alias("missing_evidence"), F.count_if(~F.col("readable")).alias("unreadable")
    )
