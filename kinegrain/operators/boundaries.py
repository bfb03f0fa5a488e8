"""Rule-based boundaries, their merging, segments, phases and run lengths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hysteresis(df: DataFrame, keys: list[str], order: str, mask: Column, hold: float, time: str = "t", out: str = "held") -> DataFrame:
    """The mask, kept up for ``hold`` seconds (inclusive) after its last true row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(mask, F.col(time)), ignorenulls=True).over(w)
    return df.withColumn(out, F.coalesce(F.col(time) <= seen + hold, F.lit(False)))


def rule_boundaries(df: DataFrame, keys: list[str], order: str, speed_change: float = 0.15, stop_speed: float = 0.015, hold: float = 0.15, grip: float = 0.5, time: str = "t", speed: str = "speed", gripper: str = "gripper") -> DataFrame:
    """(keys, order): jumps of speed, edges of the held stop mask, edges of the closed gripper."""
    w = Window.partitionBy(*keys).orderBy(order)
    h = hysteresis(df, keys, order, F.col(speed) <= stop_speed, hold, time, "__held")
    closed = F.col(gripper) >= grip
    jump = F.abs(F.col(speed) - F.lag(speed).over(w)) >= speed_change
    edge = F.col("__held") != F.coalesce(F.lag("__held").over(w), F.lit(False))
    turn = F.lag(closed).over(w) != closed
    # one pass and one filter instead of three scans joined by a union
    hit = F.coalesce(jump, F.lit(False)) | edge | F.coalesce(turn, F.lit(False))
    return h.withColumn("__hit", hit).where("__hit").select(*keys, order).distinct()


def merge_boundaries(found: DataFrame, frames: DataFrame, keys: list[str], order: str, gap: float = 0.15, time: str = "t") -> DataFrame:
    """(keys, boundaries array): strictly interior, distinct, each at least ``gap`` seconds after the last one kept.

    Every key of ``frames`` has a row, also without any boundary. Whether one is kept hangs on the last
    one kept, so the sorted boundaries of a key are folded.
    """
    span = frames.groupBy(*keys).agg(F.max(order).alias("__last"), F.min(order).alias("__first"))
    at = found.join(frames.select(*keys, order, time), [*keys, order]).select(*keys, order, time).distinct()
    lists = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(time).alias("t")))).alias("b"))
    inner = F.filter(F.coalesce("b", F.array().cast("array<struct<i:bigint,t:double>>")), lambda s: (s.i > F.col("__first")) & (s.i < F.col("__last")))
    start = F.array().cast("array<struct<i:bigint,t:double>>")
    kept = F.aggregate(inner, start, lambda acc, s: F.when((F.size(acc) == 0) | (s.t - F.element_at(acc, F.greatest(F.lit(1), F.size(acc))).t >= gap), F.concat(acc, F.array(s))).otherwise(acc))
    lists = lists.withColumn("b", F.transform("b", lambda s: F.struct(s.i.cast("bigint").alias("i"), s.t.cast("double").alias("t"))))
    return span.join(lists, keys, "left").select(*keys, F.transform(kept, lambda s: s.i).alias("boundaries"))


def boundary_segments(merged: DataFrame, frames: DataFrame, keys: list[str], order: str, least: float = 0.25, time: str = "t") -> DataFrame:
    """(keys, seg_id, start_t, end_t) between neighbouring cuts; shorter ones than ``least`` seconds are dropped."""
    ends = frames.groupBy(*keys).agg(F.min(order).alias("__a"), F.max(order).alias("__b"))
    cuts = merged.join(ends, keys).select(*keys, F.explode(F.array_distinct(F.concat(F.array(F.col("__a").cast("bigint")), "boundaries", F.array(F.col("__b").cast("bigint"))))).alias(order))
    at = cuts.join(frames.select(*keys, order, F.col(time).alias("start_t")), [*keys, order])
    w = Window.partitionBy(*keys).orderBy(order)
    seg = at.withColumn("end_t", F.lead("start_t").over(w)).where(F.col("end_t").isNotNull() & (F.col("end_t") - F.col("start_t") >= least))
    return seg.withColumn("seg_id", F.row_number().over(w) - 1).select(*keys, "seg_id", "start_t", "end_t")


# ---- phases ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class PhaseConfig:
    closed: float = 0.01
    opened: float = 0.04
    grip_dwell: int = 6
    moving: float = 0.005
    still: float = 0.002
    speed_dwell: int = 10


PHASES = ("approach", "grasp", "move", "insertion", "place", "move_to_ready")


def gripper_anchors(df: DataFrame, keys: list[str], order: str, config: PhaseConfig = PhaseConfig(), gripper: str = "gripper") -> DataFrame:
    """(keys, t_grasp, t_place): first frame from which the gripper stays closed, and later stays open, for a whole dwell."""
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, config.grip_dwell - 1)
    full = F.count(F.lit(1)).over(ahead) == config.grip_dwell
    d = df.select(*keys, order, (full & (F.max(gripper).over(ahead) < config.closed)).alias("__c"), (full & (F.min(gripper).over(ahead) > config.opened)).alias("__o"))
    d = d.withColumn("t_grasp", F.min(F.when(F.col("__c"), F.col(order))).over(Window.partitionBy(*keys)))
    return d.groupBy(*keys).agg(F.min("t_grasp").alias("t_grasp"), F.min(F.when(F.col("__o") & (F.col(order) > F.col("t_grasp")), F.col(order))).alias("t_place"))


def runs_of(df: DataFrame, keys: list[str], order: str, mask: Column) -> DataFrame:
    """(keys, run_start, run_length) of maximal runs of true rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.select(*keys, order, mask.alias("__m")).withColumn("__p", F.row_number().over(w)).where("__m")
    d = d.withColumn("__g", F.col("__p") - F.row_number().over(w))
    return d.groupBy(*keys, "__g").agg(F.min(order).alias("run_start"), F.count(F.lit(1)).alias("run_length")).drop("__g")


def fallback_anchors(df: DataFrame, keys: list[str], order: str, config: PhaseConfig = PhaseConfig(), speed: str = "speed") -> DataFrame:
    """(keys, fallback_grasp, fallback_place): first long rest within the first third, last long rest after it."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    early = df.withColumn("__third", F.floor(n / 3)).where(F.col(order) < F.col("__third"))
    dwell = 2 * config.speed_dwell
    grasp = runs_of(early, keys, order, F.col(speed) < config.still).where(F.col("run_length") >= dwell).groupBy(*keys).agg(F.min("run_start").alias("fallback_grasp"))
    rest = runs_of(df, keys, order, F.col(speed) < config.still).where(F.col("run_length") >= dwell)
    place = rest.join(grasp, keys).where("run_start > fallback_grasp").groupBy(*keys).agg(F.max("run_start").alias("fallback_place"))
    return df.select(*keys).distinct().join(grasp, keys, "left").join(place, keys, "left")


def phase_labels(df: DataFrame, anchors: DataFrame, keys: list[str], order: str, config: PhaseConfig = PhaseConfig(), speed: str = "speed") -> DataFrame:
    """Adds ``phase`` to every frame from its key's anchors.

    The grasp ends with the first lasting movement before the place (a dwell cut off by the end of the data
    counts), the insertion begins with the last lasting rest between the two, the place ends with the first
    lasting movement after it; where one is missing its phase is empty or open to the end.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = w.rowsBetween(0, config.speed_dwell - 1)
    d = df.join(anchors, keys, "left").withColumn("__moving", F.min(speed).over(ahead) > config.moving)
    i, g, p = F.col(order), F.col("t_grasp"), F.col("t_place")
    every = Window.partitionBy(*keys)
    d = d.withColumn("__ge", F.min(F.when(F.col("__moving") & (i >= g) & (i < p), i)).over(every)).withColumn("__pe", F.min(F.when(F.col("__moving") & (i >= p), i)).over(every))
    d = d.withColumn("__ge", F.coalesce("__ge", p))
    inside = d.where((i >= F.col("__ge")) & (i < p))
    rest = runs_of(inside, keys, order, F.col(speed) < config.still).where(F.col("run_length") >= config.speed_dwell).groupBy(*keys).agg(F.max("run_start").alias("__ins"))
    d = d.join(rest, keys, "left")
    both = F.when(i < g, "approach").when(i < F.col("__ge"), "grasp").when(i < F.coalesce("__ins", p), "move").when(i < p, "insertion").when(F.col("__pe").isNull() | (i < F.col("__pe")), "place").otherwise("move_to_ready")
    phase = F.when(g.isNull(), "unknown").when(p.isNull(), F.when(i < g, "approach").otherwise("grasp")).otherwise(both)
    return d.withColumn("phase", phase).drop("__moving", "__ge", "__pe", "__ins", "t_grasp", "t_place")


def run_lengths(df: DataFrame, keys: list[str], order: str, label: str, time: str = "t") -> DataFrame:
    """(keys, label, start_idx, end_idx inclusive, start_time, end_time) of runs of one label."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("__new", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1))
    d = d.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "__g", label).agg(F.min(order).alias("start_idx"), F.max(order).alias("end_idx"), F.min(time).alias("start_time"), F.max(time).alias("end_time")).drop("__g")


def phase_stats(runs: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """phase_order, phase, n, mean_s, std_s (population), min_s, max_s in fixed order; n is 0 where none was seen."""
    dim = runs.sparkSession.createDataFrame(list(enumerate(phases)), "phase_order int, phase string")
    d = runs.select("phase", (F.col("end_time") - F.col("start_time")).alias("s"))
    g = d.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_s"), F.stddev_pop("s").alias("std_s"), F.min("s").alias("min_s"), F.max("s").alias("max_s"))
    return dim.join(g, "phase", "left").withColumn("n", F.coalesce("n", F.lit(0)))
