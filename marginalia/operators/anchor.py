"""The anchor gate: quotes are looked up in the page they cite; what isn't backed is dropped, with an audit.

Tables are keyed by (book_id, page_index). All joins are equi-joins on that key, so each costs one shuffle of the narrow
side and of the normalised streams; the gate itself never sees a page's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T

PAGE = ["book_id", "page_index"]


def anchored(evidence: DataFrame, norm: DataFrame) -> DataFrame:
    """evidence with `anchored`. Text evidence must stand in the body, or (any source but 'body') in the footnotes, of the
    page it belongs to; an override of the page is not followed here. Other kinds can't be checked and pass."""
    streams = norm.select(*PAGE, "body_norm", "foot_norm")
    stream = F.when(F.col("source") == "body", F.col("body_norm")).otherwise(F.col("foot_norm"))
    holds = F.when(F.coalesce("kind", F.lit("text")) != "text", True).otherwise(T.is_anchored(T.normalized(F.col("excerpt")), stream))
    return evidence.join(streams, PAGE, "left").withColumn("anchored", holds).drop("body_norm", "foot_norm")


def kept_references(references: DataFrame, flagged: DataFrame) -> DataFrame:
    good = flagged.where("anchored").select(*PAGE, "evidence_id")
    return references.join(good, [*PAGE, "evidence_id"], "left_semi")


def gate(flagged: DataFrame, statements: DataFrame, references: DataFrame, relations: DataFrame, statement_terms: DataFrame | None = None) -> dict[str, DataFrame]:
    """What survives: statements with their refs pruned (array, in order), evidence, relations.

    A relation stays if both ends are surviving statements or terms that these use (whether or not the term has a row)."""
    refs = kept_references(references, flagged)
    kept = pruned(statements, refs)
    return {"statements": kept, "evidence": used_evidence(flagged, refs), "relations": surviving_relations(kept, relations, statement_terms)}


def pruned(statements: DataFrame, refs: DataFrame) -> DataFrame:
    """The statements that have references left, with these as an array in order."""
    lists = refs.groupBy(*PAGE, "statement_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_id"))), lambda r: r["evidence_id"]).alias("refs"))
    return statements.drop("refs").join(lists, [*PAGE, "statement_id"])


def used_evidence(flagged: DataFrame, refs: DataFrame) -> DataFrame:
    return flagged.where("anchored").join(refs.select(*PAGE, "evidence_id").distinct(), [*PAGE, "evidence_id"], "left_semi").drop("anchored")


def surviving_relations(kept: DataFrame, relations: DataFrame, statement_terms: DataFrame | None = None) -> DataFrame:
    nodes = kept.select(*PAGE, F.col("statement_id").alias("node"))
    if statement_terms is not None:
        nodes = nodes.union(statement_terms.join(kept.select(*PAGE, "statement_id"), [*PAGE, "statement_id"], "left_semi").select(*PAGE, F.col("term_id").alias("node"))).distinct()
    return relations.join(nodes.withColumnRenamed("node", "src"), [*PAGE, "src"], "left_semi").join(nodes.withColumnRenamed("node", "dst"), [*PAGE, "dst"], "left_semi")


def dropped(flagged: DataFrame, statements: DataFrame, references: DataFrame) -> DataFrame:
    """The audit: kind, id and reason of everything the gate takes out."""
    refs = kept_references(references, flagged).select(*PAGE, "statement_id").distinct()
    lost = flagged.where("not anchored").select(*PAGE, F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"), F.lit("quote not found on page").alias("reason"))
    bare = statements.join(refs, [*PAGE, "statement_id"], "left_anti").select(*PAGE, F.lit("statement").alias("kind"), F.col("statement_id").alias("id"), F.lit("ungrounded after anchor gate").alias("reason"))
    return lost.unionByName(bare)


def summary(kept: dict[str, DataFrame], audit: DataFrame) -> DataFrame:
    """Per page: statements, evidence, relations that survive, and how much was dropped; one aggregation of tagged rows."""
    names = ("statements", "evidence", "relations")
    rows = audit.select(*PAGE, F.lit("dropped").alias("what"))
    for name in names:
        rows = rows.union(kept[name].select(*PAGE, F.lit(name).alias("what")))
    return rows.groupBy(*PAGE).agg(*(F.count_if(F.col("what") == name).alias(f"n_{name}") for name in (*names, "dropped")))
