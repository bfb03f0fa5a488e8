"""Scores of boundaries and segments against a reference, and their statistics.

Matching is greedy and one-to-one, so the state of a match is folded over a key's sorted boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(pred: Column, ref: Column, tolerance: float, kind: str = "double") -> Column:
    """Number of predicted entries that find an unused reference within ``tolerance``: in order of the
    predictions, the nearest one left, the smaller of two equally near. Entries may repeat."""
    refs = F.transform(F.array_sort(ref), lambda r, i: F.struct(r.cast(kind).alias("r"), i.alias("i")))
    init = F.struct(F.lit(0).alias("tp"), refs.alias("rest"))

    def step(acc: Column, p: Column) -> Column:
        near = F.transform(F.filter(acc.rest, lambda s: F.abs(s.r - p) <= tolerance), lambda s: F.struct(F.abs(s.r - p).alias("d"), s.r.alias("r"), s.i.alias("i")))
        best = F.array_min(near)
        return F.when(F.size(near) > 0, F.struct((acc.tp + 1).alias("tp"), F.filter(acc.rest, lambda s: s.i != best.i).alias("rest"))).otherwise(acc)

    return F.aggregate(F.array_sort(pred), init, step).tp


def boundary_agreement(df: DataFrame, pred: str, ref: str, tolerance: float, strict: bool = False) -> DataFrame:
    """Adds precision, recall, f1 in frames.

    Two empty sides agree (1, 1, 1). With one empty side precision and recall are 0 and f1 is 1, as the
    method defines it; ``strict`` gives 0.
    """
    a, b = F.size(pred), F.size(ref)
    d = df.withColumn("__tp", matched(F.col(pred), F.col(ref), tolerance))
    p, r = F.col("__tp") / a, F.col("__tp") / b
    both, one = (a == 0) & (b == 0), (a == 0) | (b == 0)
    f1 = F.when(both, 1.0).when(one, 0.0 if strict else 1.0).when(F.col("__tp") == 0, 0.0).otherwise(2 * p * r / (p + r))
    return d.withColumns({"precision": F.when(both, 1.0).when(one, 0.0).otherwise(p), "recall": F.when(both, 1.0).when(one, 0.0).otherwise(r), "f1": f1}).drop("__tp")


def boundary_f1_seconds(df: DataFrame, pred: str, ref: str, tolerance: float = 0.1) -> DataFrame:
    """Adds precision, recall, f1 in seconds; 0 where a side is empty."""
    a, b = F.size(pred), F.size(ref)
    d = df.withColumn("__tp", matched(F.col(pred), F.col(ref), tolerance))
    p = F.when((a == 0) | (b == 0), 0.0).otherwise(F.col("__tp") / a)
    r = F.when((a == 0) | (b == 0), 0.0).otherwise(F.col("__tp") / b)
    d = d.withColumns({"precision": p, "recall": r})
    return d.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))).drop("__tp")


def duration_stats(df: DataFrame, keys: list[str], boundaries: str, total: str, fps: float | Column) -> DataFrame:
    """n_segments, mean_s, std_s (population), min_s, max_s, total_s of the segments between 0, the boundaries and the total."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.array_sort(boundaries), lambda x: x.cast("bigint")), F.array(F.col(total).cast("bigint")))
    d = df.withColumn("__e", edges)
    lengths = F.transform(F.slice("__e", 2, F.size("__e") - 1), lambda x, i: (x - F.element_at("__e", i + 1)).cast("double"))
    d = d.select(*keys, F.explode(lengths).alias("__d"), rate.alias("__fps")).withColumn("__d", F.col("__d") / F.col("__fps"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_segments"), F.avg("__d").alias("mean_s"), F.stddev_pop("__d").alias("std_s"), F.min("__d").alias("min_s"), F.max("__d").alias("max_s"), F.sum("__d").alias("total_s"))


def compare_methods(df: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """All unordered pairs of methods of a key: (keys, pair, precision, recall, f1).

    df: keys, method, method_ord, boundaries. The methods of a key are a handful, so pairs are made within
    one array per key and nothing is joined.
    """
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("method_ord", "method", "boundaries"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b.method_ord > a.method_ord), lambda b: F.struct(F.concat(a.method, F.lit("_vs_"), b.method).alias("pair"), a.boundaries.alias("ref"), b.boundaries.alias("pred")))))
    return boundary_agreement(g.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*"), "pred", "ref", tolerance).select(*keys, "pair", "precision", "recall", "f1")


def mean_ignoring_missing(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means without null and NaN, and n_episodes; NaN where nothing is left."""
    return df.groupBy(*by).agg(*[F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(float("nan"))).alias(c) for c in columns], F.count(F.lit(1)).alias("n_episodes"))


def segment_iou(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_matched, mean_iou): predictions in order take the best unused true segment of their label that overlaps.

    pred, truth: keys, label, start, end. Pairs are made by an equi-join on key and label, limited to overlaps.
    """
    w = lambda: Window.partitionBy(*keys).orderBy("start", "end", "label")
    p = pred.withColumn("pi", F.row_number().over(w()))
    t = truth.select(*keys, "label", F.col("start").alias("ts"), F.col("end").alias("te")).withColumn("ti", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "te", "label")))
    j = p.join(t, [*keys, "label"]).withColumn("inter", F.least("end", "te") - F.greatest("start", "ts")).where("inter > 0")
    union = (F.col("end") - F.col("start")) + (F.col("te") - F.col("ts")) - F.col("inter")
    cand = j.withColumn("iou", F.col("inter") / union).groupBy(*keys, "pi").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("neg"), "ti"))).alias("c"))
    lists = cand.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pi", "c"))).alias("s"))

    def step(acc: Column, s: Column) -> Column:
        left = F.filter(s.c, lambda x: ~F.array_contains(acc.used, x.ti))
        best = F.element_at(left, F.greatest(F.lit(1), F.lit(1)))
        return F.when(F.size(left) > 0, F.struct(F.concat(acc.used, F.array(best.ti)).alias("used"), (acc.total - best.neg).alias("total"))).otherwise(acc)

    init = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0.0).alias("total"))
    m = lists.withColumn("r", F.aggregate("s", init, step)).select(*keys, F.size("r.used").alias("n_matched"), F.col("r.total").alias("total"))
    every = pred.select(*keys).distinct().join(m, keys, "left")
    n = F.coalesce("n_matched", F.lit(0))
    return every.select(*keys, n.alias("n_matched"), F.when(n > 0, F.col("total") / n).otherwise(0.0).alias("mean_iou"))


def fps_of(df: DataFrame, keys: list[str], order: str, time: str = "t", default: float = 30.0) -> DataFrame:
    """One over the median time step, else the default."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__d", step).groupBy(*keys).agg(F.median("__d").alias("__m")).select(*keys, F.when(F.col("__m") > 0, 1 / F.col("__m")).otherwise(default).alias("fps"))


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def fmt_float(x: Column) -> Column:
    return F.when(missing(x), "N/A").otherwise(F.format_string("%.3f", x))


def fmt_int(x: Column) -> Column:
    return F.when(missing(x.cast("double")), "N/A").otherwise(x.cast("bigint").cast("string"))


def fmt_percent(x: Column) -> Column:
    return F.when(missing(x), "N/A").otherwise(F.format_string("%.1f%%", x * 100))
