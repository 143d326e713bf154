"""Connected components of an edge table by alternating large-star and small-star steps, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.sources.shared import written


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """left joined with right, which has one row a key and, as `count`, how many of left's `total` rows have it.

    Keys with over one in `share` of the rows, of which there are fewer than `share`, are broadcast, so that no task gets
    all rows of a hot key; the others meet in a shuffle. left is read twice."""
    hot = F.broadcast(right.where(F.col(count) * share > total))
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(count) * share <= total), key)
    return left.join(hot, key).unionByName(rest).drop(count)


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's least neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the least of them. Here u > v in each edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and component (its least node) for each node of an edge; edges: u, v, either way round, loops ignored.

    Each round is written to the shared folder; the loop ends when a round leaves the edges as they were, told by
    their number and the sum of their hashes. No edge or node comes to the driver."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most):
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
        now = written(_small(_large(now)), "edges")
    raise RuntimeError("components did not settle")
