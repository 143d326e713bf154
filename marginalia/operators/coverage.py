"""Coverage: which parts of a page's streams some quote covers, and which sentences none does.

Quotes meet their stream in one equi-join by page; intervals, unions and overlaps are windows and aggregations within a
page and stream. Texts don't travel beyond that join: only places do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import scan
from marginalia.operators.anchor import PAGE

STREAM = [*PAGE, "stream"]


def streams(norm: DataFrame) -> DataFrame:
    """A row for each page and stream (body, footnote), with its normalised text."""
    return norm.select(*PAGE, F.expr("stack(2, 'body', body_norm, 'footnote', foot_norm) as (stream, norm)"))


def covered_spans(evidence: DataFrame, norm: DataFrame) -> DataFrame:
    """First occurrence of each text quote in its stream. Only 'body' and 'footnote' count as streams; blank quotes don't."""
    quotes = evidence.where((F.coalesce("kind", F.lit("text")) == "text") & F.col("source").isin("body", "footnote")).select(*PAGE, F.col("source").alias("stream"), T.normalized(F.col("excerpt")).alias("quote")).where("quote <> ''")
    at = F.expr("locate(quote, norm)")
    return quotes.join(streams(norm), STREAM).select(*STREAM, (at - 1).alias("a"), (at - 1 + F.length("quote")).alias("b")).where("a >= 0")


def intervals(spans: DataFrame) -> DataFrame:
    """Spans merged where they overlap or touch: start_at, end_at. Equal spans count once, so the order has no ties."""
    spans = spans.distinct()
    order = Window.partitionBy(*STREAM).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*STREAM, "island").agg(F.min("a").alias("start_at"), F.max("b").alias("end_at")).drop("island")


def coverage(norm: DataFrame, merged: DataFrame) -> DataFrame:
    """Characters of each stream, how many are covered, and their share to three places (1 for an empty stream)."""
    got = merged.groupBy(*STREAM).agg(F.sum(F.col("end_at") - F.col("start_at")).alias("covered"))
    sizes = norm.select(*PAGE, F.expr("stack(2, 'body', length(body_norm), 'footnote', length(foot_norm)) as (stream, total_chars)"))
    c = F.coalesce("covered", F.lit(0))
    return sizes.join(got, STREAM, "left").select(*STREAM, F.col("total_chars").cast("long").alias("total_chars"), c.cast("long").alias("covered_chars"), F.when(F.col("total_chars") == 0, 1.0).otherwise(T.rounded(c.cast("double") / F.col("total_chars"), 3)).alias("ratio"))


def sentence_places(norm: DataFrame) -> DataFrame:
    """sent_no, a, b and sent of each sentence of both streams; places are running lengths (one separator each)."""
    sents = streams(norm).where("norm <> ''").select(*STREAM, F.posexplode(T.sentences(F.col("norm"))).alias("sent_no", "sent"))
    before = F.sum(F.length("sent") + 1).over(Window.partitionBy(*STREAM).orderBy("sent_no").rowsBetween(Window.unboundedPreceding, -1))
    return sents.withColumn("a", F.coalesce(before, F.lit(0))).withColumn("b", F.col("a") + F.length("sent"))


def covered_parts(parts: DataFrame, merged: DataFrame, number: str, text: str) -> DataFrame:
    """parts (STREAM, number, text, a, b) with `covered`: how much of a to b the merged intervals cover.

    One sweep over each stream's sorted places: what is covered up to a place is, of the intervals' starts and ends up to
    there, the place times the number that are open, less the sum of the starts, plus that of the ends. A part is the
    difference of two such values, so parts never meet intervals. The text travels with its end alone."""
    ends = merged.select(*STREAM, F.expr("stack(2, cast(start_at as bigint), 1, cast(end_at as bigint), -1) as (x, open)"))
    places = parts.select(*STREAM, number, F.expr(f"stack(2, a, -1, cast(null as string), b, 1, {text}) as (x, side, {text})"))
    order = Window.partitionBy(*STREAM).orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = places.unionByName(ends, allowMissingColumns=True)
    upto = F.col("x") * F.coalesce(F.sum("open").over(order), F.lit(0)) - F.coalesce(F.sum(F.col("x") * F.col("open")).over(order), F.lit(0))
    return swept.withColumn("upto", upto).where("side is not null").groupBy(*STREAM, number).agg(F.max(text).alias(text), F.min("x").alias("a"), F.max("x").alias("b"), F.sum(F.col("upto") * F.col("side")).alias("covered"))


def gaps(norm: DataFrame, merged: DataFrame, threshold: float = 0.5, least: int = 15) -> DataFrame:
    """Sentences of at least `least` characters of which less than `threshold` is covered; the share is given to two places."""
    sents = sentence_places(norm).where(F.length("sent") >= least)
    share = covered_parts(sents, merged, "sent_no", "sent").withColumn("coverage", F.col("covered").cast("double") / (F.col("b") - F.col("a")))
    return share.where(F.col("coverage") < threshold).select(*STREAM, F.col("sent_no").cast("long").alias("sent_no"), F.col("sent").alias("text"), T.rounded(F.col("coverage"), 2).alias("coverage"))


def redo_list(cover: DataFrame, sections: DataFrame, bound: float = 0.5, prose_only: bool = True) -> DataFrame:
    """Pages whose body is covered by less than `bound`, worst first by `place`, and per book their ascending list. Coverage is
    worked out once: number and list are both made from the pages as they are written."""
    low = cover.where((F.col("stream") == "body") & (F.col("ratio") < bound)).join(sections.select(*PAGE, "prose"), PAGE)
    low = low.where("prose") if prose_only else low
    placed = scan.placed(low.select(*PAGE, "ratio"), ["book_id"], ["ratio", "page_index"])
    lists = placed.groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("page_index")), lambda i: (i + 1).cast("string")), ",").alias("page_spec"))
    return scan.numbered(placed, ["book_id"], ["ratio", "page_index"], "place").select(*PAGE, "ratio", F.col("place").cast("int").alias("place")).join(lists, "book_id")
