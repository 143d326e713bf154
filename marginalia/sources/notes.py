"""Reading and writing notes: nested rows (JSON, one notes-set a page) and flat tables keyed by book and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = ["book_id", "page_index"]
NOTES = """schema_version int, source struct<document:string, scope:string, page_label:string, page_index:long, chapter_id:string, chapter_title:string, page_range:array<long>>,
    generation struct<model:string, effort:string, max_tokens:int>, detected_language string, terms array<struct<id:string, label:string>>,
    evidence array<struct<id:string, kind:string, excerpt:string, excerpt_translation:string, source:string, script:string, locator:string, caption:string, bbox:array<double>, page_label:string, page_index:long>>,
    statements array<struct<id:string, type:string, basis:string, text:string, terms:array<string>, evidence:array<string>>>,
    relations array<struct<`from`:string, `to`:string, type:string>>, _broken string"""
PAGES = "book_id string, page_index long, text string, footnotes string, expected_notes boolean"


def read_pages(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Page streams; rows without a page number are left out, missing texts are empty."""
    rows = spark.read.schema(PAGES).format(format).load(path)
    return rows.where("page_index is not null").withColumns({c: F.coalesce(c, F.lit("")) for c in ("text", "footnotes")})


def page_index_of(path: Column) -> Column:
    """The number in a name like page-0013.notes.yaml; null where the name isn't like that."""
    return F.regexp_extract(path, r"page-(\d+)\.notes\.[a-z]+$", 1).try_cast("long")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: book_id (the folder), page_index (from the name), notes (struct), readable. A file that is no JSON
    object gives a row that isn't readable; it is a problem to count, not a page that is there."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.notes.json", recursiveFileLookup=True).withColumn("path", F.input_file_name())
    return parsed_notes(files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("book_id"), page_index_of(F.col("path")).alias("page_index"), F.col("value").alias("raw")))


def parsed_notes(raw: DataFrame) -> DataFrame:
    """raw: book_id, page_index, raw (JSON)."""
    notes = F.from_json("raw", NOTES, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    out = raw.withColumn("notes", notes)
    readable = F.coalesce(F.col("notes").isNotNull() & F.col("notes._broken").isNull() & F.trim("raw").startswith("{"), F.lit(False))
    return out.withColumn("readable", readable).drop("raw")


def flattened(rows: DataFrame) -> dict[str, DataFrame]:
    """Terms, evidence, statements, references, statement terms and relations of readable rows; places are kept as pos."""
    good = rows.where("readable")

    def part(name: str, alias: str) -> DataFrame:
        return good.select(*PAGE, F.posexplode(f"notes.{name}").alias("pos", alias))

    s = part("statements", "s").select(*PAGE, "pos", F.col("s.id").alias("statement_id"), "s.type", F.col("s.basis").alias("basis"), F.coalesce("s.text", F.lit("")).alias("text"), F.coalesce("s.terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("s.evidence", F.array().cast("array<string>")).alias("refs"))
    e = part("evidence", "e").select(*PAGE, "pos", F.col("e.id").alias("evidence_id"), F.coalesce("e.kind", F.lit("text")).alias("kind"), F.col("e.source").alias("source"), F.coalesce("e.excerpt", F.lit("")).alias("excerpt"), "e.locator", "e.script", "e.caption", "e.excerpt_translation", F.col("e.page_index").alias("page_override"))
    return {
        "terms": part("terms", "t").select(*PAGE, "pos", F.col("t.id").alias("term_id"), "t.label"),
        "evidence": e,
        "statements": s,
        "references": s.select(*PAGE, "statement_id", F.posexplode("refs").alias("pos", "evidence_id")),
        "statement_terms": s.select(*PAGE, "statement_id", F.posexplode("terms").alias("pos", "term_id")),
        "relations": part("relations", "r").select(*PAGE, "pos", F.col("r.from").alias("src"), F.col("r.to").alias("dst"), F.col("r.type").alias("rel_type")),
    }


_ITEM = {
    **dict.fromkeys(("evidence_id", "kind", "source", "excerpt"), "string"), "page_override": "long", **dict.fromkeys(("statement_id", "type", "basis", "text"), "string"), "terms": "array<string>", "refs": "array<string>",
    **dict.fromkeys(("src", "dst", "rel_type", "term_id", "label"), "string"),
}


def items(rows: DataFrame) -> DataFrame:
    """Evidence, statements, relations and terms of readable rows in one table, from one scan of the notes: book_id, page_index,
    what (the name of the table in flattened) and the columns that flattened gives them, null where they are another table's."""
    none = F.array().cast("array<string>")
    fields = {
        "evidence": lambda e: {"evidence_id": e["id"], "kind": F.coalesce(e["kind"], F.lit("text")), "source": e["source"], "excerpt": F.coalesce(e["excerpt"], F.lit("")), "page_override": e["page_index"]},
        "statements": lambda s: {"statement_id": s["id"], "type": s["type"], "basis": s["basis"], "text": F.coalesce(s["text"], F.lit("")), "terms": F.coalesce(s["terms"], none), "refs": F.coalesce(s["evidence"], none)},
        "relations": lambda r: {"src": r["from"], "dst": r["to"], "rel_type": r["type"]},
        "terms": lambda t: {"term_id": t["id"], "label": t["label"]},
    }

    def listed(name: str) -> Column:
        def item(x: Column) -> Column:
            own = fields[name](x)
            return F.struct(F.lit(name).alias("what"), *(own.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _ITEM.items()))

        return F.transform(f"notes.{name}", item)

    lists = F.filter(F.array(*map(listed, fields)), lambda part: part.isNotNull())
    return rows.where("readable").select(*PAGE, F.explode(F.flatten(lists)).alias("x")).select(*PAGE, "x.*")


def nested(evidence: DataFrame, statements: DataFrame, relations: DataFrame, order: str = "pos", terms: DataFrame | None = None, statement_terms: DataFrame | None = None) -> DataFrame:
    """book_id, page_index and the notes-set as JSON: lists in the order of `order`, empty optional fields left out, evidence and
    statements always there. The document is the book.

    Optional: fields of evidence (those columns that it has), terms (term_id, label), statement_terms (statement_id, pos,
    term_id)."""

    def listed(rows: DataFrame, name: str, fields: list[Column]) -> DataFrame:
        return rows.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("x")))), lambda r: r["x"]).alias(name))

    names = {"excerpt_translation": "excerpt_translation", "script": "script", "locator": "locator", "caption": "caption", "page_override": "page_index"}
    e = listed(evidence, "evidence", [F.col("evidence_id").alias("id"), F.col("kind"), F.col("excerpt"), F.col("source"), *(F.col(c).alias(n) for c, n in names.items() if c in evidence.columns)])
    own = [F.col("statement_id").alias("id"), F.col("type"), F.nullif("basis", F.lit("author")).alias("basis"), F.col("text"), F.col("refs").alias("evidence")]
    if statement_terms is not None:
        used = statement_terms.groupBy(*PAGE, "statement_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term_id"))), lambda t: t["term_id"]).alias("own_terms"))
        statements, own = statements.join(used, [*PAGE, "statement_id"], "left"), [*own, F.col("own_terms").alias("terms")]
    s = listed(statements, "statements", own)
    r = listed(relations, "relations", [F.col("src").alias("from"), F.col("dst").alias("to"), F.col("rel_type").alias("type")])
    all_, lists = s.join(e, PAGE, "full").join(r, PAGE, "full"), ["evidence", "statements", "relations"]
    if terms is not None:
        all_, lists = all_.join(listed(terms, "terms", [F.col("term_id").alias("id"), F.col("label")]), PAGE, "left"), ["terms", *lists]
    for name in ("evidence", "statements"):
        all_ = all_.withColumn(name, F.coalesce(name, F.array().cast(all_.schema[name].dataType)))
    body = F.struct(F.lit(1).alias("schema_version"), F.struct(F.col("book_id").alias("document"), F.lit("page").alias("scope"), F.col("page_index")).alias("source"), *lists)
    return all_.select(*PAGE, F.to_json(body, {"ignoreNullFields": "true"}).alias("notes"))


def merged_pages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Page rows of both; what a page already has of text and marks stays."""
    old, add = existing.select(*PAGE, "text", "footnotes", "expected_notes"), new.select(*PAGE, *(F.col(c).alias(f"new_{c}") for c in ("text", "footnotes", "expected_notes")))
    keep = lambda c: F.coalesce(F.nullif(c, F.lit("")) if c != "expected_notes" else F.col(c), F.col(f"new_{c}"))
    return old.join(add, PAGE, "full").select(*PAGE, F.coalesce(keep("text"), F.lit("")).alias("text"), F.coalesce(keep("footnotes"), F.lit("")).alias("footnotes"), keep("expected_notes").alias("expected_notes"))


def lacking_text(pages: DataFrame) -> DataFrame:
    """Per book: whether some page still has no text."""
    return pages.groupBy("book_id").agg(F.coalesce(F.max(F.trim(F.coalesce("text", F.lit(""))) == ""), F.lit(False)).alias("lacks_text"))


def captured(pages: DataFrame, noted: DataFrame) -> DataFrame:
    """Corpus rows of a book: text pages are expected to have notes; has_notes and missing tell which have them."""
    rows = pages.withColumn("expected_notes", F.col("page_type") == "text").join(noted.select(*PAGE).distinct().withColumn("there", F.lit(True)), PAGE, "left")
    has = F.coalesce("there", F.lit(False))
    return rows.select(*PAGE, "page_type", "expected_notes", has.alias("has_notes"), (F.col("expected_notes") & ~has).alias("missing"))
