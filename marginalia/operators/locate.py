"""Locators: page specs, printed labels and passages, each resolved to page indices; a miss is no rows, never all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.anchor import PAGE
from marginalia.sources.shared import written


def label_index(pages: DataFrame) -> DataFrame:
    """book_id, label and its page indices, in order; a label may stand on several pages, pages without one are left out."""
    label = F.trim(F.col("page_label").cast("string"))
    return pages.where("page_label is not null").groupBy("book_id", label.alias("label")).agg(F.sort_array(F.collect_set("page_index")).alias("page_indices"))


def printed(queries: DataFrame, index: DataFrame) -> DataFrame:
    """queries (book_id, folio) with the bare label, its page indices and whether there are any."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("folio"), "^[pP]+", ""), r"^\.+", ""))
    met = queries.withColumn("label", bare).join(index, ["book_id", "label"], "left")
    return met.select("book_id", "folio", "label", F.coalesce("page_indices", F.array().cast("array<long>")).alias("page_indices"), F.col("page_indices").isNotNull().alias("matched"))


def _parts(specs: DataFrame) -> DataFrame:
    """place, lo and hi (null: not a number) of each non-empty part."""
    part = specs.select("*", F.posexplode(F.split("spec", ",")).alias("place", "part")).withColumn("part", F.trim("part")).where("part <> ''")
    number = lambda c: F.trim(c).try_cast("long")
    range_ = F.contains("part", F.lit("-"))
    return part.withColumn("lo", number(F.when(range_, F.substring_index("part", "-", 1)).otherwise(F.col("part")))).withColumn("hi", number(F.when(range_, F.expr("substr(part, locate('-', part) + 1)")).otherwise(F.col("part"))))


def lenient_spec(specs: DataFrame) -> DataFrame:
    """spec_id and 0-based page_index of each page that a spec names; parts that are no numbers or run backwards are skipped."""
    good = _parts(specs).where("lo is not null and hi is not null and lo <= hi")
    return good.select("spec_id", F.explode(F.sequence("lo", "hi")).alias("page")).where("page >= 1").select("spec_id", (F.col("page") - 1).alias("page_index")).distinct()


def strict_spec(specs: DataFrame) -> DataFrame:
    """spec_id, place (in the order named) and page of each different page within 1 and max_page; a part that is no number fails the job."""
    part = _parts(specs)
    checked = F.when(F.col("lo").isNull() | F.col("hi").isNull(), F.raise_error(F.concat(F.lit("not a page: "), F.col("part"))).cast("boolean")).otherwise(True)
    pages = part.where(checked).where("lo <= hi").select("spec_id", "max_page", "place", F.posexplode(F.sequence("lo", "hi")).alias("step", "page")).where("page between 1 and max_page")
    first = pages.groupBy("spec_id", "page").agg(F.min(F.struct("place", "step")).alias("at"))
    lists = first.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("at", "page"))).alias("pages"))
    return lists.select("spec_id", F.posexplode("pages").alias("place", "p")).select("spec_id", "place", F.col("p.page").alias("page"))


def _grams(words: Column, n: int) -> Column:
    """A hash of each different run of n words, told apart from runs of other lengths."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(words, i, n), " ")))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def _by_runs(small: DataFrame, large: DataFrame, most: int) -> DataFrame:
    """small_id and large_id of texts that share the rarest of small's inner runs; the first and last word may be cut, the
    others stand whole in a text that holds them."""
    inner = small.where("n >= 3").select("small_id", F.slice("words", F.lit(2), F.col("n") - 2).alias("words"), F.least(F.col("n") - 2, F.lit(most)).alias("run_words"))
    lengths = [r[0] for r in inner.select("run_words").distinct().collect()]  # at most `most` numbers
    if not lengths:
        return small.sparkSession.createDataFrame([], "small_id long, large_id long")
    own = F.coalesce(*(F.when(F.col("run_words") == n, _grams(F.col("words"), n)) for n in lengths))
    asked = inner.select("small_id", F.explode(own).alias("run"))
    runs = large.select("large_id", F.explode(F.concat(*(_grams(F.col("words"), n) for n in lengths))).alias("run"))
    met = written(runs.join(asked.select("run").distinct(), "run", "left_semi"), "runs")
    count = met.groupBy("run").agg(F.count("*").alias("n"))
    rarest = asked.join(count, "run", "left").groupBy("small_id").agg(F.min_by("run", F.coalesce("n", F.lit(0))).alias("run"))  # a run that is nowhere: no text holds it
    return rarest.join(met, "run").select("small_id", "large_id")


def _pieces(text: Column, n: int) -> Column:
    """All runs of n letters of a text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, runs).otherwise(F.array().cast("array<string>"))


def _by_letters(small: DataFrame, large: DataFrame, n: int) -> DataFrame:
    """The same for texts of one word or two: they stand inside n neighbouring words. Different words (or pairs) that hold
    the text are found by its first letters, then the texts that have those words."""
    few = small.where(F.col("n") == n)
    sizes = [r[0] for r in few.select(F.least(F.length("text"), F.lit(3)).alias("c")).distinct().collect()]  # at most three numbers
    if not sizes:
        return small.sparkSession.createDataFrame([], "small_id long, large_id long")
    token = F.when(F.size("words") >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")))).otherwise(F.array().cast("array<string>"))
    tokens = written(large.select("large_id", F.explode(token).alias("token")), "tokens")
    letters = F.concat(*(_pieces(F.col("token"), c) for c in sizes))
    known = tokens.select("token").distinct().select("token", F.explode(F.array_distinct(letters)).alias("gram"))
    hits = few.select("small_id", "text", F.left("text", F.least(F.length("text"), F.lit(3))).alias("gram")).join(known, "gram").where(F.contains("token", F.col("text")))
    return hits.select("small_id", "token").join(tokens, "token").select("small_id", "large_id")


def contained(small: DataFrame, large: DataFrame, most: int = 5) -> DataFrame:
    """small_id and large_id where small's text stands in large's. small: small_id, text; large: large_id, text; texts are
    normalised, with single spaces.

    Containment has no equi-key, so it gets one: a text of three words or more is looked up by its rarest run of up to
    `most` inner words, a shorter one by its first letters among the different words. Only ids and hashes of runs are
    exploded and joined; texts come back by id, for a full check of each candidate."""
    longest = large.agg(F.max(F.length("text"))).first()[0] or 0
    words = F.split("text", " ")
    few = small.where(F.length("text") <= longest).withColumn("words", words).withColumn("n", F.size("words"))
    many = large.withColumn("words", words)
    pairs = _by_runs(few, many, most).union(_by_letters(few, many, 1)).union(_by_letters(few, many, 2)).distinct()
    texts = large.select("large_id", F.col("text").alias("large_text"))
    return pairs.join(texts, "large_id").join(small.select("small_id", "text"), "small_id").where(F.contains("large_text", F.col("text"))).select("small_id", "large_id").distinct()


def passages(passages: DataFrame, streams: DataFrame) -> DataFrame:
    """passage_id and each (book_id, page_index) of whose excerpts one holds the passage or is held by it.

    passages: passage_id, text. streams: book_id, page_index, excerpt. Equal texts are compared once."""
    p = passages.select("passage_id", T.normalized_passage(F.col("text")).alias("text")).where("text <> ''").withColumn("id", F.xxhash64("text"))
    s = streams.select(*PAGE, T.normalized_passage(F.col("excerpt")).alias("text")).where("text <> ''").withColumn("id", F.xxhash64("text"))
    p, s = written(p, "passages"), written(s, "excerpts")
    needles, hays = p.select("id", "text").distinct(), s.select("id", "text").distinct()

    def sides(small: DataFrame, large: DataFrame) -> DataFrame:
        return contained(small.withColumnRenamed("id", "small_id"), large.withColumnRenamed("id", "large_id"))

    within = sides(needles, hays).select(F.col("small_id").alias("p"), F.col("large_id").alias("s"))
    around = sides(hays, needles).select(F.col("large_id").alias("p"), F.col("small_id").alias("s"))
    met = within.union(around).distinct()
    return met.join(p.select("passage_id", F.col("id").alias("p")), "p").join(s.select(*PAGE, F.col("id").alias("s")), "s").select("passage_id", *PAGE).distinct()


def bundle(notes: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """The notes of the chosen pages (book_id, page_index); all of them where nothing is chosen."""
    return notes if chosen is None else notes.join(chosen.select(*PAGE).distinct(), PAGE, "left_semi")
