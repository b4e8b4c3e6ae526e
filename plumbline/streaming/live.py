"""Streaming forms: the same expressions over unbounded inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconciled_stream(a: DataFrame, b: DataFrame, key: str, time: str, value: str, delay: str = "1 hour") -> DataFrame:
    """Stream-stream full outer join of two sources of one series within a
    watermark: rows that the other source never sends come out as left_only or
    right_only when it passes."""
    left = a.select(F.col(key).alias("key_a"), F.col(time).alias("time_a"), F.col(value).alias("value_a")).withWatermark("time_a", delay)
    right = b.select(F.col(key).alias("key_b"), F.col(time).alias("time_b"), F.col(value).alias("value_b")).withWatermark("time_b", delay)
    near = F.expr(f"key_a = key_b AND time_b BETWEEN time_a - INTERVAL {delay} AND time_a + INTERVAL {delay}")
    both = left.join(right, near, "full_outer")
    side = F.when(F.col("key_b").isNull(), "left_only").when(F.col("key_a").isNull(), "right_only").otherwise("both")
    return both.withColumn("_merge", side).withColumn("diff", F.abs(F.col("value_a") - F.col("value_b")))


def visible_counts(facts: DataFrame, announced: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """How many facts became visible in each window; late ones count within the watermark."""
    return facts.withWatermark(announced, delay).groupBy(F.window(announced, window)).agg(F.count("*").alias("n"))
