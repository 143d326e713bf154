"""Running numbers, sums and fills over groups of any size, in two levels, so that no task gets a whole group.

placed() deals rows by ranges of key and order over the tasks and notes each row's task; it is written once, since the ranges
must stay as they are. A scan then runs within each (key, task), and what comes in from earlier tasks is worked out on one
row for each of these: a window over as many rows as a key has tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.shared import written

PART = "_part"


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with the task that each falls in: tasks follow each other in the order of keys and `order`, equal rows together."""
    return written(rows.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "placed")


def _within(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys, PART).orderBy(*order)


def _incoming(rows: DataFrame, keys: list[str], own: Column, over: str) -> DataFrame:
    """For each key and task, what its earlier tasks come to: their sum, or the last of them that isn't null."""
    order = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*keys, PART).agg(own.alias("_own"))
    before = F.coalesce(F.sum("_own").over(order), F.lit(0)) if over == "sum" else F.last("_own", ignorenulls=True).over(order)
    return each.select(*keys, PART, before.alias("_before"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number within the key, from 1; order must tell rows apart, else equal ones are numbered at will."""
    own = rows.withColumn(name, F.row_number().over(_within(keys, order)))
    return own.join(_incoming(rows, keys, F.count("*"), "sum"), [*keys, PART]).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_before")


def totalled(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the running sum of a whole number, their own included."""
    own = rows.withColumn(name, F.sum(value).over(_within(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(_incoming(rows, keys, F.sum(value), "sum"), [*keys, PART]).withColumn(name, (F.coalesce(name, F.lit(0)) + F.col("_before")).cast("long")).drop("_before")


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the last value up to them that isn't null."""
    own = rows.withColumn(name, F.last(value, ignorenulls=True).over(_within(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    return own.join(_incoming(rows, keys, last, "last"), [*keys, PART]).withColumn(name, F.coalesce(name, "_before")).drop("_before")


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the value of the row before, null for the first; values aren't null."""
    own = rows.withColumn(name, F.lag(value).over(_within(keys, order)))
    last = F.max_by(value, F.struct(*order))
    return own.join(_incoming(rows, keys, last, "last"), [*keys, PART]).withColumn(name, F.coalesce(name, "_before")).drop("_before")
