"""Transitions, sizes, pooled means, representatives and silhouettes of labelled items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _range(df: DataFrame, k: int, name: str) -> DataFrame:
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias(name))


def transitions(df: DataFrame, keys: list[str], order: str, label: str, k: int) -> DataFrame:
    """(a, b, n) of neighbouring labels for all pairs below ``k``; others are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = df.select(F.col(label).alias("a"), F.lead(label).over(w).alias("b")).where(F.col("b").isNotNull() & F.col("a").between(0, k - 1) & F.col("b").between(0, k - 1)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    every = _range(df, k, "a").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return every.join(n, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cluster_sizes(df: DataFrame, label: str, k: int) -> DataFrame:
    n = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return _range(df, k, "label").join(n, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mean_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, pooled): element-wise mean of the vectors of a key."""
    e = df.select(*keys, F.posexplode(vector).alias("__p", "__x")).groupBy(*keys, "__p").agg(F.avg("__x").alias("__m"))
    return e.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__m"))), lambda s: s["__m"]).alias("pooled"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, x: acc + x))


def representatives(df: DataFrame, label: str, item: str, vector: str) -> DataFrame:
    """(label, representative, distance): the member nearest to its cluster's mean, the smaller of two equally near."""
    d = df.join(mean_pool(df, [label], vector), label).withColumn("__d", distance(F.col(vector), F.col("pooled")))
    best = F.min(F.struct("__d", item))
    return d.groupBy(label).agg(best.alias("b")).select(label, F.col(f"b.{item}").alias("representative"), F.col("b.__d").alias("distance"))


def silhouettes(df: DataFrame, keys: list[str], item: str, cluster: str, vector: str) -> DataFrame:
    """(keys, silhouette): mean over the items of a key; keys with one cluster are left out.

    Distances are needed between all items of a key: those of one recording's segments, a few dozen.
    """
    a = df.select(*keys, F.col(item).alias("__i"), F.col(cluster).alias("__c"), F.col(vector).alias("__v"))
    b = df.select(*keys, F.col(cluster).alias("__oc"), F.col(vector).alias("__ov"))
    near = a.join(b, keys).groupBy(*keys, "__i", "__c", "__oc").agg(F.sum(distance(F.col("__v"), F.col("__ov"))).alias("__s"), F.count(F.lit(1)).alias("__n"))
    own = F.col("__c") == F.col("__oc")
    per = near.groupBy(*keys, "__i").agg(F.max(F.when(own, F.col("__n"))).alias("n"), F.max(F.when(own & (F.col("__n") > 1), F.col("__s") / (F.col("__n") - 1))).alias("a"), F.min(F.when(~own, F.col("__s") / F.col("__n"))).alias("b"))
    score = F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.where("b is not null").groupBy(*keys).agg(F.avg(score).alias("silhouette"))
