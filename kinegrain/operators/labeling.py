"""Labels of segments from what their frames show: membership by range join, shares, scores, best label."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TaskProfile:
    """Thresholds and zones of a task."""

    name: str = "charger_insertion"
    pick_zone_center: tuple[float, float, float] = (0.38, 0.12, 0.07)
    insertion_zone_center: tuple[float, float, float] = (0.61, -0.05, 0.02)
    ready_pose: tuple[float, float, float] = (0.31, 0.0, 0.22)
    pick_zone_radius_xy: float = 0.10
    insertion_zone_radius_xy: float = 0.08
    pick_zone_z_tol: float = 0.06
    insertion_z_tol: float = 0.04
    ready_pose_tol: float = 0.09
    speed_change_threshold: float = 0.15
    stop_speed_threshold: float = 0.015
    move_speed_threshold: float = 0.04
    precision_speed_threshold: float = 0.02
    gripper_event_hysteresis_s: float = 0.20
    min_segment_duration_s: float = 0.25
    hysteresis_duration_s: float = 0.15
    alignment_tolerance: float = 0.12


_PROFILES = {"charger_insertion": TaskProfile()}


def task_profile(name: str, **overrides) -> TaskProfile:
    """A registered profile, with changes; unknown names and keys raise ValueError."""
    if name not in _PROFILES:
        raise ValueError(f"unknown task profile {name!r}")
    unknown = set(overrides) - {f.name for f in fields(TaskProfile)}
    if unknown:
        raise ValueError(f"unknown profile keys {sorted(unknown)}")
    return replace(_PROFILES[name], **overrides)


LABELS = ("approach", "grasp", "move", "insertion", "place", "move_to_ready")


def as_of(frames: DataFrame, segments: DataFrame, keys: list[str], time: str, number: str, start: str, end: str) -> DataFrame:
    """Frames with the ``number``, ``start`` and ``end`` of each segment that holds them, both ends included.

    Segments of a key don't overlap but at their ends. The last segment that started, and the one before it, are
    carried along the time of a key: one window, and no pairs of frames and segments.
    """
    w = Window.partitionBy(*keys).orderBy("__at", "__kind")
    parts = (number, start, end)
    s = segments.select(*keys, F.col(start).alias("__at"), F.lit(0).alias("__kind"), *[F.col(c).alias(f"__now_{c}") for c in parts])
    s = s.withColumns({f"__last_{c}": F.lag(f"__now_{c}").over(w) for c in parts})
    f = frames.withColumns({"__at": F.col(time), "__kind": F.lit(1)})
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    u = f.unionByName(s, allowMissingColumns=True)
    u = u.withColumns({f"__now_{c}": F.last(f"__now_{c}", ignorenulls=True).over(until) for c in parts})
    # of one segment, so carried along with it: a first segment has none before it
    before = {f"__last_{c}": F.last(F.when(F.col("__kind") == 0, F.struct(f"__last_{c}")), ignorenulls=True).over(until)[f"__last_{c}"] for c in parts}
    u = u.withColumns(before).where("__kind = 1")
    both = F.array(*[F.struct(*[F.col(f"__{x}_{c}").alias(c) for c in parts]) for x in ("last", "now")])
    held = F.filter(both, lambda x: (F.col("__at") >= x.getField(start)) & (F.col("__at") <= x.getField(end)))
    return u.select(*[c for c in frames.columns], F.explode(held).alias("__s")).select(*frames.columns, "__s.*")


def segment_facts(frames: DataFrame, segments: DataFrame, keys: list[str], p: TaskProfile) -> DataFrame:
    """One row per segment with the shares and means its label depends on.

    frames: keys, t, x, y, z, speed, gripper (0 to 1), alignment. Segments touch at cuts, but don't overlap;
    a frame on a cut belongs to both. Segments without frames are left out.
    """
    j = as_of(frames.withColumnRenamed("t", "__t"), segments, keys, "__t", "seg_id", "start_t", "end_t")
    closed = F.col("gripper") >= 0.5
    w = Window.partitionBy(*keys, "seg_id").orderBy("__t")
    j = j.withColumn("__turn", F.when(F.lag(closed).over(w) != closed, 1).otherwise(0))
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    xy = lambda c: F.sqrt((F.col("x") - c[0]) * (F.col("x") - c[0]) + (F.col("y") - c[1]) * (F.col("y") - c[1]))
    return j.groupBy(*keys, "seg_id", "start_t", "end_t").agg(
        (share(~closed) > 0.6).alias("g_open"), (share(closed) > 0.6).alias("g_closed"), F.sum("__turn").alias("transitions"),
        (share(xy(p.pick_zone_center) <= p.pick_zone_radius_xy) > 0.5).alias("near_pick"), (share(F.abs(F.col("z") - p.pick_zone_center[2]) <= p.pick_zone_z_tol) > 0.5).alias("near_pick_z"),
        (share(xy(p.insertion_zone_center) <= p.insertion_zone_radius_xy) > 0.5).alias("near_insert"), (share(F.abs(F.col("z") - p.insertion_zone_center[2]) <= p.insertion_z_tol) > 0.5).alias("near_insert_z"),
        (share(xy(p.ready_pose) <= p.ready_pose_tol) > 0.5).alias("near_ready"),
        (F.avg("speed") > p.move_speed_threshold).alias("moving"), (F.avg("speed") <= p.precision_speed_threshold).alias("precise"), (F.avg("alignment") >= 1 - p.alignment_tolerance).alias("aligned"),
    )


def label_segments(facts: DataFrame, keys: list[str]) -> DataFrame:
    """label, confidence and evidence of each segment. Scores are hundredths, so ties are ties; the first label in order wins one."""
    w = Window.partitionBy(*keys).orderBy("seg_id").rowsBetween(Window.unboundedPreceding, 0)
    f = facts.withColumn("release_now", (F.col("transitions") > 0) & F.col("g_open")).withColumn("released", F.max("release_now").over(w))
    c = F.col
    # fixed values: label, condition, score in hundredths, evidence
    table: list[tuple[str, Column, int, str]] = [
        ("approach", c("near_pick"), 35, "near pick-zone (xy)"), ("approach", c("near_pick_z"), 20, "pick-zone z alignment"), ("approach", c("g_open"), 35, "gripper mostly open"),
        ("grasp", c("transitions") > 0, 45, "gripper transition detected"), ("grasp", c("g_closed"), 30, "gripper mostly closed"), ("grasp", c("near_pick"), 20, "grasp near pick-zone"),
        ("move", c("g_closed"), 35, "closed gripper while moving"), ("move", c("moving"), 40, "ee speed above move threshold"), ("move", ~c("near_insert"), 15, "not yet in insertion zone"),
        ("insertion", c("near_insert"), 35, "near insertion zone (xy)"), ("insertion", c("near_insert_z"), 20, "insertion z alignment"), ("insertion", c("aligned"), 25, "pose alignment high"), ("insertion", c("precise"), 15, "low-speed precision motion"),
        ("place", c("release_now"), 45, "gripper release event"), ("place", c("near_insert"), 25, "place at goal zone"), ("place", ~c("moving"), 20, "settled after release"),
        ("move_to_ready", c("released") | c("release_now"), 30, "after release phase"), ("move_to_ready", c("near_ready"), 40, "near ready pose"), ("move_to_ready", c("moving") | c("near_ready"), 20, "return-to-ready trajectory"),
    ]
    scores = {n: sum((F.when(cond, pts).otherwise(0) for m, cond, pts, _ in table if m == n), F.lit(0)) for n in LABELS}
    f = f.withColumns({f"__s_{n}": s for n, s in scores.items()})
    top = F.greatest(*[c(f"__s_{n}") for n in LABELS])
    label = F.coalesce(*[F.when(c(f"__s_{n}") == top, n) for n in LABELS])
    confidence = F.least(F.lit(1.0), top / 100 + F.least(F.lit(0.15), 0.05 * c("transitions")))
    evidence = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(cond, text) for _, cond, _, text in table]), lambda e: e.isNotNull())))
    return f.select(*keys, "seg_id", "start_t", "end_t", label.alias("label"), confidence.alias("confidence"), evidence.alias("evidence"))
