"""Corpus preparation in five stages; each works on all that the one before kept.

language ID -> one document of each near-duplicate group -> passages of earlier documents out -> secrets out -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import language_id, near_copies, packing, secrets, substring_dedup
from marginalia.llm.common import table, written


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts too), and those that no language or several fit, go.

    Dictionaries are learned as in the operator's query. Without any language in the table, all documents go. Each row is
    judged on its own, so repeated rows fare alike; all columns stay as they are, whatever their names."""
    contents = language_id.dictionaries(docs.where(language_id.id_hash_mod(4) != 2))
    return language_id.kept(docs, contents)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose 5-word shingles are alike by 0.8 or more, the row with the least doc_id stays.

    Candidates come from the SimHash operator (its search over 5-word shingles) and from MinHash for what that search
    can't reach. Null and empty texts are alike; of rows without a doc_id one stays only where no row has one. Rows of one
    doc_id with unlike texts are told apart, rows alike in all columns are one. All columns stay, whatever their names."""
    return near_copies.kept(docs)


def _counted(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """changed with the columns of docs, its character counts brought up to date."""
    rows = changed.select(*(f"`{c}`" for c in docs.columns))
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that an earlier document has go; texts without such, null and empty ones too, stay as they
    are. Rows of one doc_id are one document; a null doc_id comes before all. All columns stay, n_chars is counted anew."""
    return _counted(docs, substring_dedup.removed(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret becomes a mark; the document stays. Null texts stay null. The network is trained on a bounded
    sample of these documents; without any candidate (an empty table, say) the base patterns alone decide. All columns stay,
    n_chars is counted anew."""
    return _counted(docs, secrets.redacted(docs, secrets.trained(docs)))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids, with their ids; a null or empty text is its end id alone, equal rows are
    packed each on its own, an empty table gives no rows. Other columns of docs are left out."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]

#: Compression, components of near copies, network scores and tokenizers are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on the documents of sf_dir, each written to the shared folder and read again; the
    pieces of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
