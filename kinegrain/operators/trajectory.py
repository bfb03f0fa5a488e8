"""From the signals of a trajectory to labelled segments: rules, change-points, or both."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrain.functions.changepoints import pelt, tidy
from kinegrain.functions.costs import make_cost
from kinegrain.operators.boundaries import boundary_segments, merge_boundaries, rule_boundaries
from kinegrain.operators.kernels import _per_recording
from kinegrain.operators.labeling import TaskProfile, label_segments, segment_facts
from kinegrain.runtime import materialize

RULES = ("rules", "b")
CHANGES = ("ruptures", "a")
PENALTY = 5.0


def change_boundaries(frames: DataFrame, key: str, order: str, least: float, penalty: float = PENALTY) -> DataFrame:
    """(key, boundaries, status, error, runtime_s): penalised change-points on x, y, z, speed and gripper; segments last ``least`` seconds on average sampling."""

    def make(m: np.ndarray) -> list[dict]:
        step = float(np.mean(np.diff(m[:, 0]))) if len(m) > 1 else 1.0
        size = max(2, math.ceil(least / step)) if step > 0 else 2
        return [{"boundaries": tidy(pelt(make_cost("rbf", m[:, 1:]), penalty, size), len(m))}]

    v = frames.select(key, order, F.array("t", "x", "y", "z", "speed", "gripper").alias("v"))
    return _per_recording(v, key, order, "v", make, "boundaries array<bigint>")


def detect_boundaries(frames: DataFrame, key: str, order: str, profile: TaskProfile, method: str = "hybrid") -> DataFrame:
    """(key, boundaries, error) by ``rules`` (b), ``ruptures`` (a) or ``hybrid``; any other method finds none. ``error`` tells why a recording has no change-points."""
    failed = frames.select(key, F.lit(None).cast("string").alias("error")).limit(0)
    found = frames.select(key, order).limit(0)
    if method in (*RULES, "hybrid"):
        found = found.union(rule_boundaries(frames, [key], order, profile.speed_change_threshold, profile.stop_speed_threshold, profile.hysteresis_duration_s))
    if method in (*CHANGES, "hybrid"):
        # written, as it is read twice
        own = materialize(change_boundaries(frames, key, order, profile.min_segment_duration_s), "changes")
        found = found.union(own.select(key, F.explode("boundaries").alias(order)))
        failed = own.where("status = 'error'").select(key, "error")
    return merge_boundaries(found.distinct(), frames, [key], order, profile.hysteresis_duration_s).join(failed, key, "left")


def segment_trajectories(frames: DataFrame, key: str, order: str, profile: TaskProfile, method: str = "hybrid") -> DataFrame:
    """Labelled segments of every trajectory (key, order, t, x, y, z, speed, gripper, alignment)."""
    cuts = detect_boundaries(frames, key, order, profile, method)
    parts = boundary_segments(cuts, frames, [key], order, profile.min_segment_duration_s)
    return label_segments(segment_facts(frames, parts, [key], profile), [key]).join(cuts.select(key, "error"), key)
