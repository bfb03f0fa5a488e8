"""The whole run over recordings: features, boundaries of several methods, primitives, statistics and agreement."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrain.functions.changepoints import ChangeConfig, run_methods
from kinegrain.functions.primitives import PrimitiveConfig, discover
from kinegrain.functions.segmenters import AVAILABLE, run_segmenter
from kinegrain.operators.evaluation import compare_methods, duration_stats, mean_ignoring_missing
from kinegrain.operators.features import NEEDS, FeatureConfig, normalize_modality, recording_features
from kinegrain.operators.kernels import _spread, change_points
from kinegrain.runtime import materialize

METHODS = ("pelt", "binseg", "window", "bottomup")

PRIMITIVES_DDL = "struct<status:string,reason:string,k:int,labels:array<int>,sizes:array<int>,transitions:array<array<double>>,representatives:array<int>,silhouette:double,runtime_s:double>"
RESULTS_DDL = (
    "modality string, status string, reason string, n_frames bigint, fps double, feature_names array<string>, "
    f"methods array<struct<method:string,boundaries:array<bigint>,runtime_s:double>>, primitives {PRIMITIVES_DDL}"
)


def _timed(work, *args):
    began = time.perf_counter()
    out = work(*args)
    return out, time.perf_counter() - began


def process_recordings(
    df: DataFrame, key: str, order: str, modality: str, features: FeatureConfig = FeatureConfig(), change: ChangeConfig = ChangeConfig(), primitives: PrimitiveConfig | None = PrimitiveConfig(),
    segmenters: tuple[str, ...] = AVAILABLE, methods: tuple[str, ...] = ("pelt", "binseg"), names: list[str] | None = None,
) -> DataFrame:
    """One row per recording: status and reason, its grid, the boundaries and time of every method, and its primitives.

    Columns t, and q, q_cmd or ee_pose. Features, searches and primitives of a recording are worked out in one
    pass, so frames move once. The time of the searches that share a cost is booked in equal parts. A recording
    without the modality's signals is ``skipped``, one that fails is an ``error``, each with its reason; a part
    that fails or is switched off (no ``segmenters``, ``primitives`` None) is told within.
    """
    modality = normalize_modality(modality)
    needed = NEEDS[modality]

    def primitive(x: np.ndarray, bounds: list[int]) -> dict:
        if primitives is None or not bounds:
            return {"status": "skipped", "reason": "switched off" if primitives is None else "fewer than two segments"}
        found, took = _timed(discover, x, bounds, primitives)
        if found is None:
            return {"status": "skipped", "reason": "no number of clusters could be fitted", "runtime_s": took}
        return {"status": "success", "runtime_s": took, **found}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        row = {"__key": pdf[key].iloc[0], "modality": modality, "status": "success", "reason": None, "n_frames": None, "fps": None, "feature_names": None, "methods": None, "primitives": None}
        lost = [c for c in needed if pdf[c].isna().all()]
        try:
            if lost:
                raise KeyError(f"no {', '.join(lost)}")
            at, own, x, _ = recording_features(pdf, modality, features, names)
            found, took = _timed(run_methods, x, change, methods)
            every = [{"method": m, "boundaries": b, "runtime_s": took / len(found)} for m, b in found.items()]
            for s in segmenters:
                b, spent = _timed(run_segmenter, s, x, len(found[methods[0]]) + 1)
                every.append({"method": s, "boundaries": b, "runtime_s": spent})
            row |= {"n_frames": len(at), "fps": 1.0 / float(np.median(np.diff(at))) if len(at) > 1 else None, "feature_names": own, "methods": every, "primitives": primitive(x, found[methods[0]])}
        except KeyError as e:
            row |= {"status": "skipped", "reason": str(e.args[0])}
        except Exception as e:  # noqa: BLE001 - one bad recording must not fail the job
            row |= {"status": "error", "reason": str(e)}
        return pd.DataFrame([row])

    kind = df.schema[key].dataType.simpleString()
    out = _spread(df.select(key, order, "t", *needed), key).groupBy(key).applyInPandas(run, f"__key {kind}, {RESULTS_DDL}")
    return out.withColumnRenamed("__key", key)


def method_rows(results: DataFrame, key: str) -> DataFrame:
    """(key, modality, status, reason, method, method_ord, boundaries, n_frames, fps, runtime_s): a row per method, or one without a method."""
    each = F.posexplode_outer("methods").alias("method_ord", "m")
    return results.select(key, "modality", "status", "reason", "n_frames", "fps", each).select(
        key, "modality", "status", "reason", F.col("m.method").alias("method"), "method_ord", F.col("m.boundaries").alias("boundaries"), "n_frames", "fps", F.col("m.runtime_s").alias("runtime_s")
    )


def mean_runtimes(found: DataFrame) -> DataFrame:
    """modality, method and its mean runtime, the fastest first."""
    return found.where("method is not null").groupBy("modality", "method").agg(F.avg("runtime_s").alias("runtime_s")).orderBy("modality", F.col("runtime_s").asc_nulls_last())


def skipped(results: DataFrame) -> DataFrame:
    """How many recordings were skipped or failed, by modality and reason; primitives that were skipped count as such."""
    whole = results.where("status <> 'success'").select("modality", "status", "reason")
    part = results.where("primitives.status = 'skipped'").select("modality", F.lit("primitives skipped").alias("status"), F.col("primitives.reason").alias("reason"))
    return whole.unionByName(part).groupBy("modality", "status", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy("modality", "status", "reason")


def pipeline_boundaries(features: DataFrame, key: str, order: str, vector: str, config: ChangeConfig, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(key, method, method_ord, boundaries, n_frames, status, error, runtime_s) of every recording."""
    found = change_points(features, key, order, vector, config, methods)
    frames = features.groupBy(key).agg(F.count(F.lit(1)).alias("n_frames"))
    order_of = F.create_map(*[x for k, m in enumerate(methods) for x in (F.lit(m), F.lit(k))])
    return found.join(frames, key).withColumn("method_ord", F.try_element_at(order_of, F.col("method")))


def pipeline_summary(found: DataFrame, key: str, fps: float | None, tolerance: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Duration statistics per method and agreement per pair of methods, both averaged over recordings.

    ``fps`` None takes each recording's own. Recordings without a result are counted in the statistics' row ``failed``.
    """
    # written, as it is read several times
    found = materialize(found, "found")
    good = found.where("status = 'success'")
    failed = found.where("status = 'error'").agg(F.lit("failed").alias("method"), F.countDistinct(key).alias("n_episodes")).where("n_episodes > 0")
    stats = duration_stats(good, [key, "method"], "boundaries", "n_frames", F.col("fps") if fps is None else fps)
    pairs = compare_methods(good.select(key, "method", "method_ord", "boundaries"), [key], tolerance)
    columns = ["n_segments", "mean_s", "std_s", "min_s", "max_s", "total_s"]
    means = mean_ignoring_missing(stats, ["method"], columns)
    none = failed.select("method", *[F.lit(float("nan")).alias(c) for c in columns], "n_episodes")
    return means.unionByName(none), mean_ignoring_missing(pairs, ["pair"], ["precision", "recall", "f1"])
