"""A sink of rows by page: written in batches, with a manifest of finished pages, read back with each page once.

Data goes to folders by batch and bucket (of the document and a run of its pages), overwritten one by one, so a batch that is
run again replaces what it wrote before. The manifest (book, page, bucket, batch) is written after the data: what a killed
run left without it is as if it weren't there. Of a page in several batches the last one counts, so a forced run replaces
pages without touching the old files. Resuming reads the manifest alone, and of it only the buckets that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.anchor import PAGE

BUCKETS, RUN = 64, 256
_MANIFEST = "book_id string, page_index long, batch int, bucket int"


def bucket(buckets: int = BUCKETS) -> Column:
    """A book's pages lie in runs, so that a large book is dealt over many buckets."""
    return F.pmod(F.xxhash64("book_id", F.floor(F.col("page_index") / RUN)), F.lit(buckets)).cast("int")


def write_data(rows: DataFrame, path: str, batch: int) -> None:
    parts = rows.withColumn("batch", F.lit(batch)).withColumn("bucket", bucket())
    parts.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)


def put(rows: DataFrame, path: str, batch: int) -> None:
    """Writes a batch's rows (PAGE and more; any number a page), then the pages that are finished."""
    write_data(rows, f"{path}/data", batch)
    done = rows.sparkSession.read.schema(_with_places(rows.schema)).parquet(f"{path}/data").where(F.col("batch") == batch)
    write_data(done.select(*PAGE).distinct(), f"{path}/manifest", batch)


def _with_places(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])


def finished(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """book_id, page_index, bucket and (last) batch of the finished pages, in the given buckets or all."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "book_id string, page_index long, bucket int, batch int")
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    rows = rows.where(F.col("bucket").isin(buckets)) if buckets is not None else rows
    return rows.groupBy(*PAGE, "bucket").agg(F.max("batch").alias("batch"))


def unfinished(pages: DataFrame, path: str, force: bool = False, before: int | None = None) -> DataFrame:
    """The pages that still have to be done: all with force, else those that the manifest (of batches under `before`) hasn't."""
    if force:
        return pages
    wanted = pages.withColumn("_bucket", bucket())
    asked = [r[0] for r in wanted.select("_bucket").distinct().collect()]  # BUCKETS numbers at most
    done = finished(pages.sparkSession, path, asked)
    done = done if before is None else done.where(F.col("batch") < before)
    return wanted.join(done.select(*PAGE), PAGE, "left_anti").drop("_bucket")


def next_batch(spark: SparkSession, path: str) -> int:
    last = finished(spark, path).agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1


def current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Each finished page's rows, those of its last batch."""
    rows = spark.read.schema(_with_places(schema)).parquet(f"{path}/data")
    return rows.join(finished(spark, path), [*PAGE, "bucket", "batch"]).select(*schema.fieldNames())
