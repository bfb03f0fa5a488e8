"""Deterministic samples of ordered items; a limit is their feature."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinegrain.runtime import materialize


def _ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``__i``, the position in the order, without moving all rows into one task.

    Rows are range-partitioned; the positions before each range are summed up from one count per range.
    They are written with the number of their range, as the bounds are sampled anew whenever they are worked out.
    """
    p = materialize(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()), "ranges")
    local = p.withColumn("__l", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return local.join(before, "__part").withColumn("__i", F.col("__l") - 1 + F.col("__before")).drop("__part", "__l", "__before")


def systematic_sample(df: DataFrame, order: list[str], n: int, seed: int = 42) -> DataFrame:
    """n evenly spread items: positions int(phase + i * N/n), the phase drawn once. All, if there are no more than n."""
    if n <= 0:
        raise ValueError("n must be positive")
    total = df.count()
    if n >= total:
        return df
    stride = total / n
    phase = random.Random(seed).random() * stride
    pick = df.sparkSession.range(n).select(F.floor(F.lit(phase) + F.col("id") * F.lit(stride)).cast("bigint").alias("__i"))
    return _ranked(df, order).join(pick, "__i", "left_semi").drop("__i")


def linspace_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Items at the truncated positions of n evenly spaced points from the first to the last."""
    total = df.count()
    if n <= 0 or total == 0:
        return df.limit(0)
    step = (total - 1) / (n - 1) if n > 1 else 0.0
    at = F.when(F.col("id") == n - 1, total - 1 if n > 1 else 0).otherwise(F.floor(F.col("id") * F.lit(step))).cast("bigint")
    pick = df.sparkSession.range(n).select(at.alias("__i")).distinct()
    return _ranked(df, order).join(pick, "__i", "left_semi").drop("__i")
