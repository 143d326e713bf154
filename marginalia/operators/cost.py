"""Cost of extraction calls from their token counts and a price table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimate(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with `cost`: null where the model has no prices. Prices are per million tokens.

    What was written to the cache counts at the five-minute rate, but for the part given as one-hour (never below 0)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    hour = n("cache_1h")
    five = F.greatest(n("cache_create") - hour, F.lit(0.0))
    total = n("input_tokens") * F.col("p_input") + n("output_tokens") * F.col("p_output") + five * F.col("p_write_5m") + hour * F.col("p_write_1h") + n("cache_read") * F.col("p_read")
    return usage.join(prices, "model", "left").withColumn("cost", total / 1_000_000).drop("p_input", "p_output", "p_write_5m", "p_write_1h", "p_read")


def run_cost(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: the priced calls' sum (null where none is priced), and how many of all calls are priced."""
    return costs.groupBy(*keys).agg(F.sum("cost").alias("cost"), F.count("cost").alias("priced"), F.count("*").alias("calls"))
