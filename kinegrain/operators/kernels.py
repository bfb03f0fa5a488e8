"""Numeric kernels run per recording: change-points, segmenters, primitives, low-pass, kinematics.

One recording is one group. A kernel that fails gives a row with status ``error`` and the reason, never a
failed job. The kernels' time is quadratic in a recording's length at worst, their memory is not, so a
recording of any length is worked out.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrain.functions.changepoints import ChangeConfig, penalty_sweep, run_methods
from kinegrain.functions.costs import make_cost
from kinegrain.functions.primitives import PrimitiveConfig, discover
from kinegrain.functions.segmenters import AVAILABLE, run_segmenter
from kinegrain.functions.signals import Model, lowpass, rotation_to_quat


def _spread(df: DataFrame, key: str) -> DataFrame:
    """By recording, over all of the shuffle's partitions: the kernels' time isn't in their input's bytes, by which the engine would merge partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _per_recording(df: DataFrame, key: str, order: str, vector: str, make: Callable[[np.ndarray], list[dict]], columns: str) -> DataFrame:
    """``make`` turns a recording's (T, D) matrix into rows; adds key, status, error and runtime_s."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        began = time.perf_counter()
        try:
            rows, status, error = make(np.array(pdf[vector].tolist(), dtype=float).reshape(len(pdf), -1)), "success", None
        except Exception as e:  # noqa: BLE001 - one bad recording must not fail the job
            rows, status, error = [{}], "error", str(e)
        took = time.perf_counter() - began
        return pd.DataFrame([{"__key": pdf[key].iloc[0], **{n: r.get(n) for n in names}, "status": status, "error": error, "runtime_s": took / max(1, len(rows))} for r in rows])

    kind = df.schema[key].dataType.simpleString()
    small = df.select(key, order, vector)
    out = _spread(small, key).groupBy(key).applyInPandas(run, f"__key {kind}, {columns}, status string, error string, runtime_s double")
    return out.withColumnRenamed("__key", key)


def change_points(df: DataFrame, key: str, order: str, vector: str, config: ChangeConfig = ChangeConfig(), methods: tuple[str, ...] = ("pelt", "binseg")) -> DataFrame:
    """(key, method, boundaries, status, error, runtime_s)."""
    return _per_recording(df, key, order, vector, lambda x: [{"method": m, "boundaries": b} for m, b in run_methods(x, config, methods).items()], "method string, boundaries array<bigint>")


def penalty_elbows(df: DataFrame, key: str, order: str, vector: str, config: ChangeConfig = ChangeConfig()) -> DataFrame:
    """(key, penalty, penalties, counts): the chosen penalty and the curve it was read from."""

    def make(x: np.ndarray) -> list[dict]:
        p, tried, counts = penalty_sweep(make_cost(config.model, x), config)
        return [{"penalty": p, "penalties": tried.tolist(), "counts": counts.tolist()}]

    return _per_recording(df, key, order, vector, make, "penalty double, penalties array<double>, counts array<bigint>")


def segmenter_benchmark(df: DataFrame, key: str, order: str, vector: str, config: ChangeConfig = ChangeConfig(), names: tuple[str, ...] = AVAILABLE) -> DataFrame:
    """(key, method, boundaries, ...) of the further segmenters; their hint is the number of segments of the penalised optimum."""

    def make(x: np.ndarray) -> list[dict]:
        hint = len(run_methods(x, config, ("pelt",))["pelt"]) + 1
        return [{"method": n, "boundaries": run_segmenter(n, x, hint)} for n in names]

    return _per_recording(df, key, order, vector, make, "method string, boundaries array<bigint>")


def primitives(df: DataFrame, key: str, order: str, vector: str, change: ChangeConfig = ChangeConfig(), config: PrimitiveConfig = PrimitiveConfig()) -> DataFrame:
    """(key, k, labels of the segments, silhouette): recurring primitives between the penalised boundaries; no row's labels where there are fewer than two segments."""

    def make(x: np.ndarray) -> list[dict]:
        return [discover(x, run_methods(x, change, ("pelt",))["pelt"], config) or {}]

    return _per_recording(df, key, order, vector, make, "k int, labels array<int>, silhouette double")


def lowpass_series(df: DataFrame, key: str, order: str, column: str, rate: float, cutoff: float = 8.0, order_n: int = 3) -> DataFrame:
    """(key, order, smoothed): zero-phase low-pass; fewer than eight rows take a moving average of five, too short ones an error."""
    kind, okind = df.schema[key].dataType.simpleString(), df.schema[order].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = pdf[column].to_numpy(float)
        error = None
        try:
            if len(x) < 8:
                e = np.pad(x, 2, mode="edge")
                y = np.convolve(e, np.full(5, 0.2), "valid")
            else:
                y = lowpass(x, rate, cutoff, order_n)
        except Exception as e:  # noqa: BLE001
            y, error = np.full(len(x), np.nan), str(e)
        return pd.DataFrame({"__key": pdf[key], "__order": pdf[order], "smoothed": y, "error": error})

    out = _spread(df.select(key, order, column), key).groupBy(key).applyInPandas(run, f"__key {kind}, __order {okind}, smoothed double, error string")
    return out.withColumnRenamed("__key", key).withColumnRenamed("__order", order)


def forward_kinematics(df: DataFrame, state: str, urdf: str, names: list[str], frame: str, extra: dict[str, int] | None = None, out: str = "ee_pose") -> DataFrame:
    """Adds ``out``: x, y, z, qx, qy, qz, qw of ``frame``; frames that have the column already keep theirs.

    Rows don't depend on each other, so nothing is grouped or moved.
    """
    had = out in df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(urdf)
        for pdf in batches:
            x = np.array([[np.nan if e is None else e for e in v] if v is not None else [np.nan] * len(names) for v in pdf["__state"]], dtype=float).reshape(len(pdf), -1)
            pos, rot = model.forward(model.q_of(x, names, extra), frame) if len(pdf) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            pose = np.concatenate([pos, rotation_to_quat(np.nan_to_num(rot))], axis=1) if len(pdf) else np.zeros((0, 7))
            yield pdf.drop(columns="__state").assign(__pose=list(pose))

    d = df.withColumn("__state", F.col(f"`{state}`").cast("array<double>"))
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "__state")
    made = d.mapInPandas(run, f"{rest}, __pose array<double>")
    value = F.coalesce(F.col(out), F.col("__pose")) if had else F.col("__pose")
    return made.withColumn(out, value).drop("__pose")


def frame_poses(df: DataFrame, state: str, urdf: str, names: list[str], frames: list[str], extra: dict[str, int] | None = None) -> DataFrame:
    """(episode_id, ee_frame, frame_idx, t, position, quaternion, rpy) of several frames of a robot, a row for each."""
    out = None
    for frame in frames:
        p = lambda k: F.element_at("__pose7", k)
        x, y, z, w = (p(k) for k in (4, 5, 6, 7))
        rpy = F.array(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))
        one = forward_kinematics(df.select("episode_id", "frame_idx", "t", state), state, urdf, names, frame, extra, "__pose7")
        one = one.select("episode_id", F.lit(frame).alias("ee_frame"), "frame_idx", "t", F.slice("__pose7", 1, 3).alias("position"), F.slice("__pose7", 4, 4).alias("quaternion"), rpy.alias("rpy"))
        out = one if out is None else out.unionByName(one)
    return out
