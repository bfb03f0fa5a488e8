"""Timelines, label statistics, frame-to-segment assignment and the written reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinegrain.operators.labeling import as_of


def rename_for_report(segments: DataFrame) -> DataFrame:
    """Labelled segments (start_t, end_t) under the names the reports use."""
    return segments.withColumnRenamed("start_t", "start").withColumnRenamed("end_t", "end")


def timeline(segments: DataFrame, keys: list[str]) -> DataFrame:
    """segment_id from 0 by (start, end) and a duration that is never negative."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "label")
    return segments.withColumn("segment_id", F.row_number().over(w) - 1).withColumn("duration", F.greatest(F.lit(0.0), F.col("end") - F.col("start")))


def label_duration_stats(segments: DataFrame, keys: list[str] = ()) -> DataFrame:
    d = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    return segments.withColumn("__d", d).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("__d").alias("total_s"), F.avg("__d").alias("mean_s"), F.min("__d").alias("min_s"), F.max("__d").alias("max_s"))


def low_confidence(segments: DataFrame, threshold: float = 0.5) -> DataFrame:
    return segments.where(F.col("confidence") < threshold)


def frame_segments(frames: DataFrame, segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """segment of every frame, both ends included, the later one where two hold it, -1 where none does."""
    f = frames.select(*keys, order, F.col("t").alias("__t"))
    s = segments.select(*keys, "segment_id", "start", "end")
    # keys whose segments overlap need every pair; the others carry the last segment along
    until = F.max("end").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("__over", F.coalesce(until > F.col("start"), F.lit(False))).withColumn("__over", F.max("__over").over(Window.partitionBy(*keys)))
    pairs = f.join(s.where("__over"), keys).where((F.col("__t") >= F.col("start")) & (F.col("__t") <= F.col("end"))).select(*keys, order, "segment_id")
    apart = as_of(f, s.where("not __over"), keys, "__t", "segment_id", "start", "end").select(*keys, order, "segment_id")
    hit = pairs.unionByName(apart).groupBy(*keys, order).agg(F.max("segment_id").alias("segment_id"))
    return f.select(*keys, order).join(hit, [*keys, order], "left").withColumn("segment_id", F.coalesce("segment_id", F.lit(-1)))


def summary_sections(segments: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """The three sections of a sample's summary as one table with a ``section`` column."""
    t = timeline(segments, keys)
    parts = [
        t.withColumn("section", F.lit("timeline")),
        label_duration_stats(segments, keys).withColumn("section", F.lit("label_duration_stats")),
        low_confidence(t, threshold).withColumn("section", F.lit("low_confidence")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def boundary_strings(df: DataFrame, keys: list[str], boundaries: str = "boundaries") -> DataFrame:
    """``boundary_frames``: the sorted frames joined by semicolons."""
    return df.select(*keys, F.array_join(F.transform(F.array_sort(boundaries), lambda x: x.cast("string")), ";").alias("boundary_frames"))


def phase_results(anchors: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t_grasp, t_place, boundaries): the anchors of a recording and its runs of one phase in order."""
    lists = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_idx", "end_idx", "phase", "start_time", "end_time"))).alias("boundaries"))
    return anchors.select(*keys, "t_grasp", "t_place").join(lists, keys, "left")


def write_sample_reports(segments: DataFrame, keys: list[str], folder: str, threshold: float = 0.5) -> None:
    """``segments.json``, the timeline of every sample as JSON lines, and ``summary.csv``, its three sections; partitioned by sample."""
    write_json(timeline(segments, keys), f"{folder}/segments.json")
    flat = summary_sections(segments, keys, threshold)
    complex_columns = [f.name for f in flat.schema if f.dataType.typeName() in ("array", "map", "struct")]
    flat = flat.withColumns({c: F.to_json(c) for c in complex_columns}) if complex_columns else flat
    flat.repartition(*keys).sortWithinPartitions(*keys, "section").write.mode("overwrite").partitionBy(*keys).option("header", True).csv(f"{folder}/summary.csv")


def write_poses(poses: DataFrame, path: str) -> None:
    """Poses (episode_id, ee_frame, frame_idx, t, position, quaternion, rpy) as one folder per episode and frame of the robot."""
    poses.repartition("episode_id", "ee_frame").sortWithinPartitions("episode_id", "ee_frame", "frame_idx").write.mode("overwrite").partitionBy("episode_id", "ee_frame").parquet(path)


def plot_table(features: DataFrame, results: DataFrame, key: str, dims: int = 3) -> DataFrame:
    """(key, k, t, head, methods): the first ``dims`` features of every grid point and the methods with a boundary there, ready to be drawn."""
    at = results.select(key, F.explode("methods").alias("m")).select(key, F.col("m.method").alias("__m"), F.explode("m.boundaries").alias("k"))
    cuts = at.groupBy(key, "k").agg(F.array_sort(F.collect_set("__m")).alias("methods"))
    head = features.where("k is not null").select(key, "k", "t", F.slice("x", 1, dims).alias("head"))
    return head.join(cuts, [key, "k"], "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def selected_ids_json(ids: DataFrame, column: str = "episode_id") -> str:
    """The record of a sample of episodes; a sample is small by its definition."""
    chosen = [r[0] for r in ids.select(column).orderBy(column).collect()]
    return json.dumps({"selected_episode_ids": chosen, "num_selected": len(chosen)})


def comparison_markdown(stats: DataFrame, pairs: DataFrame, runtimes: DataFrame | None = None, skips: DataFrame | None = None) -> str:
    """Report of aggregates (a few rows per modality and method): statistics, pairwise agreement, runtimes."""

    def cell(v) -> str:
        if v is None or v != v:
            return "N/A"
        return f"{v:.3f}" if isinstance(v, float) else str(v)

    def grid(df: DataFrame) -> list[str]:
        # aggregates: a row per method, pair or reason
        rows = df.limit(1000).collect()
        head = df.columns
        return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(cell(r[c]) for c in head) + " |" for r in rows)]

    out = ["# Comparison", "", "## Durations", "", *grid(stats), "", "## Agreement", "", *grid(pairs)]
    if runtimes is not None:
        out += ["", "## Runtimes", "", *grid(runtimes.orderBy(F.col("runtime_s").asc_nulls_last()))]
    if skips is not None:
        out += ["", "## Skipped", "", *grid(skips)]
    return "\n".join(out) + "\n"
