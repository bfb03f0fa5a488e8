"""Series, labelling and evaluation operators against plain Python on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrain.operators import boundaries as B
from kinegrain.operators import evaluation as V
from kinegrain.operators import features as X
from kinegrain.operators import kernels as K
from kinegrain.operators import labeling as L
from kinegrain.operators import report as R
from kinegrain.operators import timeseries as S
from kinegrain.operators.sampling import linspace_sample, systematic_sample


def series(spark, *values, step=1.0):
    return spark.createDataFrame([(e, i, i * step, v) for e, own in enumerate(values) for i, v in enumerate(own)], "episode int, frame int, t double, x double")


def column(df, name, order="frame"):
    return [r[name] for r in df.orderBy("episode", order).collect()]


def test_fill_and_drop(spark):
    df = series(spark, [None, 1.0, float("nan"), 2.0])
    assert column(S.clean_rows(df, ["episode"], "frame", ["x"]), "x") == [1.0, 1.0, 2.0]
    assert column(S.clean_rows(df, ["episode"], "frame", ["x"], "none"), "x") == [1.0, 2.0]
    assert S.clean_rows(series(spark, [None, None]), ["episode"], "frame", ["x"]).count() == 0
    with pytest.raises(ValueError):
        S.clean_rows(df, ["episode"], "frame", ["x"], "guess")


def test_resampling(spark):
    rows = [(0, 0, 100.0, 0.0), (0, 1, 101.0, 2.0), (0, 2, 104.0, 8.0), (1, 0, 5.0, 1.0), (2, 0, 1.0, 0.0), (2, 1, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "episode int, frame int, t double, x double")
    out = S.resample_linear(df, ["episode"], "frame", ["x"], dt=1.0).orderBy("k").collect()
    assert [r.t for r in out] == [100, 101, 102, 103, 104] and [r.x for r in out] == [0, 2, 4, 6, 8]
    assert {r.episode: r.status for r in S.resample_status(df, ["episode"], "frame").collect()} == {0: "success", 1: "error", 2: "error"}
    with pytest.raises(ValueError):
        S.resample_linear(df, ["episode"], "frame", ["x"], dt=0.0)


def test_savgol_reproduces_cubics_and_short_series(spark):
    cubic = [float(i**3 - 4 * i) for i in range(30)]
    df = series(spark, cubic, [1.0, 2.0, 9.0], [float(i**2) for i in range(8)], [5.0])
    got = {}
    for r in S.savgol(df, ["episode"], "frame", "x").orderBy("episode", "frame").collect():
        got.setdefault(r.episode, []).append(r.x)
    assert got[0] == pytest.approx(cubic, abs=1e-6)
    assert got[2] == pytest.approx([float(i**2) for i in range(8)], abs=1e-8)
    pad = np.pad([1.0, 2.0, 9.0], 2, mode="edge")
    assert got[1] == pytest.approx(np.convolve(pad, np.full(5, 0.2), "valid"))
    assert got[3] == pytest.approx([5.0])


@pytest.mark.parametrize("n", [1, 2, 4, 13])
def test_stencils_equal_numpy(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = series(spark, x.tolist())
    pad = np.pad(x, 2, mode="edge")
    assert column(S.moving_average(df, ["episode"], "frame", "x", 5), "x") == pytest.approx(np.convolve(pad, np.full(5, 0.2), "valid"))
    w = S.gaussian_weights(1.5)
    r = len(w) // 2
    wide = np.pad(x, r, mode="symmetric")
    assert column(S.gaussian_smooth(df, ["episode"], "frame", "x", 1.5), "x") == pytest.approx(np.convolve(wide, w, "valid"))
    wide = np.pad(x, 2, mode="symmetric")
    assert column(S.median_filter(df, ["episode"], "frame", "x", 5), "x") == pytest.approx([np.median(wide[i : i + 5]) for i in range(n)])
    grad = np.gradient(x) if n > 1 else [0.0]
    assert column(S.gradient(df, ["episode"], "frame", "x", "g"), "g") == pytest.approx(grad)


def test_scaling(spark):
    x = [1.0, 2.0, 2.5, 9.0, -3.0]
    df = series(spark, x, [4.0, 4.0])
    m = np.median(x)
    assert column(S.robust_scale(df, ["episode"], "x").where("episode = 0"), "x") == pytest.approx((np.array(x) - m) / (1.4826 * np.median(np.abs(np.array(x) - m))))
    assert column(S.robust_scale(df, ["episode"], "x", "iqr").where("episode = 1"), "x") == [0.0, 0.0]
    with pytest.raises(ValueError):
        S.robust_scale(df, ["episode"], "x", "odd")


def test_feature_names():
    assert X.normalize_modality("Ablation") == "joint_command"
    with pytest.raises(ValueError):
        X.normalize_modality("sound")
    assert X.infer_modality({"position"}) == "cartesian" and X.infer_modality({"q", "q_cmd"}) == "joint_command" and X.infer_modality({"q"}) == "joint"
    assert X.joint_weight("q_0", {"0": 3.0}) == 1.0
    assert X.joint_weight("q_right_arm_0", {"right_arm": 2.0, "0": 5.0}) == 10.0
    assert X.grouped_positions(["a", "b", "c"], {"g": ["c", "zz", "a"]}) == [("g", 0, 2), ("g", 1, 0)]


def test_boundaries(spark):
    rows = [(0, i, float(i), s, g) for i, (s, g) in enumerate([(1.0, 0.0), (1.0, 0.0), (0.0, 0.0), (1.0, 1.0), (1.0, 1.0), (1.0, 0.0)])] + [(1, 0, 0.0, 1.0, 0.0), (1, 1, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "episode int, frame int, t double, speed double, gripper double")
    found = B.rule_boundaries(df, ["episode"], "frame", 0.5, 0.1, 1.0, 0.5)
    assert sorted(r.frame for r in found.collect()) == [2, 3, 4, 5]
    merged = B.merge_boundaries(found, df, ["episode"], "frame", 2.0)
    assert {r.episode: r.boundaries for r in merged.collect()} == {0: [2, 4], 1: []}
    seg = B.boundary_segments(merged, df, ["episode"], "frame", 1.5).orderBy("episode", "seg_id").collect()
    assert [(r.episode, r.start_t, r.end_t) for r in seg] == [(0, 0.0, 2.0), (0, 2.0, 4.0)]


def test_phases_without_anchors(spark):
    df = series(spark, [0.5] * 4).withColumn("speed", F.lit(0.0))
    a = B.gripper_anchors(df, ["episode"], "frame", gripper="x")
    assert a.first().t_grasp is None
    assert set(column(B.phase_labels(df, a, ["episode"], "frame"), "phase")) == {"unknown"}


def plain_match(pred, ref, tol):
    rest, tp = sorted(ref), 0
    for p in sorted(pred):
        near = [(abs(r - p), r) for r in rest if abs(r - p) <= tol]
        if near:
            rest.remove(min(near)[1])
            tp += 1
    return tp


def test_matching(spark):
    rng = random.Random(0)
    rows = [(k, sorted(rng.choices(range(40), k=rng.randint(0, 8))), sorted(rng.choices(range(40), k=rng.randint(0, 8)))) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, p array<int>, r array<int>")
    got = {r.k: r.tp for r in df.select("k", V.matched(F.col("p"), F.col("r"), 3).alias("tp")).collect()}
    assert got == {k: plain_match(p, r, 3) for k, p, r in rows}
    x = spark.createDataFrame([([], []), ([1], [])], "p array<int>, r array<int>")
    out = V.boundary_agreement(x, "p", "r", 1).collect()
    assert [(o.precision, o.f1) for o in out] == [(1.0, 1.0), (0.0, 1.0)]
    assert V.boundary_agreement(x, "p", "r", 1, strict=True).collect()[1].f1 == 0.0
    assert V.boundary_f1_seconds(x, "p", "r").collect()[0].f1 == 0.0


def test_iou(spark):
    p = spark.createDataFrame([(0, "a", 0.0, 2.0), (0, "a", 2.0, 4.0), (0, "b", 4.0, 5.0)], "e int, label string, start double, end double")
    t = spark.createDataFrame([(0, "a", 1.0, 3.0), (0, "c", 4.0, 5.0)], "e int, label string, start double, end double")
    r = V.segment_iou(p, t, ["e"]).first()
    assert r.n_matched == 1 and r.mean_iou == pytest.approx(1 / 3)


def test_formats(spark):
    r = spark.createDataFrame([(None, 0.1234), (float("nan"), 1.0)], "a double, b double").select(V.fmt_float(F.col("a")).alias("a"), V.fmt_percent(F.col("b")).alias("b")).collect()
    assert [x.a for x in r] == ["N/A", "N/A"] and r[0].b == "12.3%"


def test_profiles():
    assert L.task_profile("charger_insertion", move_speed_threshold=1.0).move_speed_threshold == 1.0
    with pytest.raises(ValueError):
        L.task_profile("nothing")
    with pytest.raises(ValueError):
        L.task_profile("charger_insertion", zone=1)


def test_samples(spark):
    df = spark.range(50).select(F.col("id").alias("e"))
    stride = 50 / 7
    phase = random.Random(42).random() * stride
    assert sorted(r.e for r in systematic_sample(df, ["e"], 7).collect()) == [int(phase + i * stride) for i in range(7)]
    assert systematic_sample(df, ["e"], 60).count() == 50
    assert sorted(r.e for r in linspace_sample(df, ["e"], 9).collect()) == np.linspace(0, 49, 9, dtype=int).tolist()
    assert [r.e for r in linspace_sample(df, ["e"], 1).collect()] == [0]
    with pytest.raises(ValueError):
        systematic_sample(df, ["e"], 0)


def test_kernel_errors_are_rows(spark):
    df = series(spark, [1.0, 2.0] * 10, [3.0]).select("episode", "frame", F.array("x").alias("v"))
    out = K.change_points(df, "episode", "frame", "v", K.ChangeConfig(model="odd"))
    assert {r.status for r in out.collect()} == {"error"}
    ok = K.change_points(df, "episode", "frame", "v", K.ChangeConfig(model="l2", penalty=1.0)).collect()
    assert {(r.episode, r.status) for r in ok} == {(0, "success"), (1, "success")}


def test_report(spark):
    s = spark.createDataFrame([(0, "a", 1.0, 0.5, 0.2), (0, "b", 0.0, 1.0, None)], "e int, label string, start double, end double, confidence double")
    t = {r.label: (r.segment_id, r.duration) for r in R.timeline(s, ["e"]).collect()}
    assert t == {"b": (0, 1.0), "a": (1, 0.0)}
    assert [r.label for r in R.low_confidence(s).collect()] == ["a"]
    text = R.comparison_markdown(s.select("label", "confidence"), s.select("label"))
    assert "N/A" in text and "0.200" in text


def test_long_recordings_are_worked_out(spark):
    df = spark.range(20_500).selectExpr("1 as episode", "cast(id as int) as frame", "array(if(id < 9000, 0.0D, 50.0D)) as v")
    config = K.ChangeConfig(model="l2", penalty=1000.0)
    assert [(r.method, r.boundaries, r.status, r.error) for r in K.change_points(df, "episode", "frame", "v", config, ("pelt",)).collect()] == [("pelt", [9000], "success", None)]
    config = K.ChangeConfig(model="rbf", penalty=100.0, jump=50)
    assert [(r.boundaries, r.status) for r in K.change_points(df, "episode", "frame", "v", config, ("pelt",)).collect()] == [([9000], "success")]


def test_failed_kernels_are_told(spark, monkeypatch):
    from kinegrain.operators import trajectory as T
    from kinegrain.plans.pipeline import pipeline_summary

    rows = [("a", "pelt", 0, [4], 10, "success"), ("b", None, None, None, 10, "error")]
    found = spark.createDataFrame(rows, "episode string, method string, method_ord int, boundaries array<bigint>, n_frames bigint, status string")
    assert {r.method: (r.n_segments, r.n_episodes) for r in pipeline_summary(found, "episode", 10.0)[0].collect() if r.method != "failed"} == {"pelt": (2.0, 1)}
    assert [(r.n_episodes, str(r.mean_s)) for r in pipeline_summary(found, "episode", 10.0)[0].where("method = 'failed'").collect()] == [(1, "nan")]

    frames = spark.range(40).selectExpr("id div 20 as episode", "id % 20 as frame", "(id % 20) / 10.0D as t", "0.0D as x", "0.0D as y", "0.0D as z", "0.0D as speed", "if(id < 20, 0.0D, null) as gripper")
    profile = L.task_profile("charger_insertion")
    monkeypatch.setattr(T, "change_boundaries", lambda f, key, *_: f.select(key).distinct().selectExpr(key, "cast(null as array<bigint>) boundaries", "if(episode = 1, 'error', 'success') status", "if(episode = 1, 'no memory', null) error"))
    assert sorted((r.episode, r.error) for r in T.detect_boundaries(frames, "episode", "frame", profile).collect()) == [(0, None), (1, "no memory")]
    assert [r.error for r in T.detect_boundaries(frames, "episode", "frame", profile, "rules").collect()] == [None, None]


def test_frames_of_segments_that_overlap_or_not(spark):
    frames = spark.createDataFrame([(e, i, float(i)) for e in (1, 2, 3) for i in range(12)], "e int, i int, t double")
    segments = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 4.0, 6.0), (1, 2, 8.0, 9.0), (2, 0, 0.0, 10.0), (2, 1, 2.0, 3.0)], "e int, segment_id int, start double, end double")
    got = {(r.e, r.i): r.segment_id for r in R.frame_segments(frames, segments, ["e"], "i").collect()}
    assert [got[1, i] for i in range(12)] == [0, 0, 0, 0, 1, 1, 1, -1, 2, 2, -1, -1]
    assert [got[2, i] for i in range(12)] == [0, 0, 1, 1, *[0] * 7, -1]
    assert {got[3, i] for i in range(12)} == {-1}


# ---- features of whole vectors -----------------------------------------------------------------


def test_vectors_equal_columns(spark):
    """The numpy pass over vectors and the engine's windows over columns give the same joint features."""
    from kinegrain.operators import features as Fe

    rng = np.random.default_rng(2)
    rows = []
    for e, n in enumerate((3, 7, 40)):
        t = np.cumsum(rng.uniform(0.02, 0.05, n))
        rows += [(e, i, float(t[i]), [float(v) for v in rng.normal(size=2)]) for i in range(n)]
    df = spark.createDataFrame(rows, "e int, i int, t double, q array<double>")
    for smoothing in ("savgol", "moving_average", "none"):
        for normalize in ("mad", "iqr"):
            c = Fe.FeatureConfig(smoothing=smoothing, window=7, polyorder=3, normalize=normalize)
            vectors = {(r.e, r.k): r.x for r in Fe.feature_matrices(df, "e", "i", "joint", c).collect()}
            wide = df.select("e", "i", F.col("i").alias("frame"), "t", F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
            names = [p + x for p in ("", "d_", "dd_") for x in ("a", "b")]
            columns = Fe.scale_columns(Fe.derivatives(wide, ["e"], ["a", "b"], c), ["e"], dict.fromkeys(names, "joint"), c)
            for r in columns.collect():
                assert vectors.pop((r.e, r.k)) == pytest.approx([r[n] for n in names], abs=1e-6), (smoothing, normalize, r.e, r.k)
            assert not vectors


def test_widths_names_groups_and_weights(spark):
    from kinegrain.operators import features as Fe

    t = np.linspace(0, 1.3, 40)
    q = np.sin(t[:, None] + np.linspace(0, 0.5, 4))
    pose = np.concatenate([np.column_stack([np.sin(t), np.cos(t), t]), np.tile([0.0, 0, 0, 1], (40, 1))], axis=1)
    df = spark.createDataFrame([(0, i, float(t[i]), q[i].tolist(), (q[i] + 0.05).tolist(), pose[i].tolist()) for i in range(40)], "e int, i int, t double, q array<double>, q_cmd array<double>, ee_pose array<double>")
    width = lambda m, c=Fe.FeatureConfig(), names=None, d=df: [(len(r.x), r.names) for r in Fe.feature_matrices(d, "e", "i", m, c, names).where("k = 0").collect()][0]
    assert width("joint")[0] == 12 and width("ablation")[0] == 20 and width("cartesian")[0] == 18
    assert width("cartesian", d=df.withColumn("ee_pose", F.slice("ee_pose", 1, 3)))[0] == 9
    groups = {"arm": ["b", "d", "no"], "hand": ["c"], "none": ["x"]}
    n, names = width("joint_command", Fe.FeatureConfig(joint_groups=groups), ["a", "b", "c", "d"])
    assert n == 15 and names[:6] == ["q_arm_0", "q_arm_1", "dq_arm_0", "dq_arm_1", "ddq_arm_0", "ddq_arm_1"] and names[6:10] == ["q_cmd_arm_0", "q_cmd_arm_1", "q_err_arm_0", "q_err_arm_1"] and names[10] == "q_hand_0"
    assert width("joint", Fe.FeatureConfig(joint_groups={"x": ["y"]}), ["a"])[0] == 0
    plain = {r.k: r.x for r in Fe.feature_matrices(df, "e", "i", "joint").collect()}
    heavy = {r.k: r.x for r in Fe.feature_matrices(df, "e", "i", "joint", Fe.FeatureConfig(block_weights={"joint": 2.0})).collect()}
    assert heavy[7] == pytest.approx([2 * v for v in plain[7]])
    bad = Fe.feature_matrices(df.withColumn("q_cmd", F.slice("q_cmd", 1, 3)), "e", "i", "joint_command").collect()
    assert [(r.k, r.error) for r in bad] == [(None, "state and command differ in width")]


def test_a_run_tells_what_it_skips(spark):
    from kinegrain.functions.changepoints import ChangeConfig
    from kinegrain.functions.primitives import PrimitiveConfig
    from kinegrain.operators import features as Fe
    from kinegrain.plans import pipeline as Pl

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (80, 2)), rng.normal(3, 0.1, (80, 2))])
    rows = [("a", i, i / 30, x[i].tolist(), None) for i in range(160)] + [("b", i, 0.0, [0.0, 1.0], None) for i in range(5)] + [("c", i, i / 30, None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i int, t double, q array<double>, q_cmd array<double>")
    run = lambda m, **kw: {r.k: r for r in Pl.process_recordings(df, "k", "i", m, Fe.FeatureConfig(smoothing="none", normalize="none"), ChangeConfig(model="l2", penalty=50.0), **kw).collect()}
    got = run("joint", primitives=PrimitiveConfig(window=4, max_iter=5), segmenters=("clasp",))
    assert got["a"].status == "success" and [m.method for m in got["a"].methods] == ["pelt", "binseg", "clasp"] and any(abs(b - 80) <= 1 for b in got["a"].methods[0].boundaries)
    assert got["a"].fps == pytest.approx(30) and got["a"].primitives.status == "success" and sum(got["a"].primitives.sizes) == len(got["a"].primitives.labels)
    assert got["b"].status == "error" and "rise" in got["b"].reason and got["c"].status == "skipped"
    assert {r.status for r in run("joint_command").values()} == {"skipped"}
    off = run("joint", primitives=None, segmenters=())
    assert off["a"].primitives.reason == "switched off" and len(off["a"].methods) == 2


def test_poses_and_apertures(spark):
    from kinegrain.operators import kernels as Ke
    from kinegrain.operators import timeseries as Ts
    from kinegrain.plans.segment_queries import ARM

    df = spark.createDataFrame([("e", i, i / 30, [0.3 * i, -0.1 * i]) for i in range(4)], "episode_id string, frame_idx int, t double, q array<double>")
    got = Ke.frame_poses(df, "q", ARM, ["j1", "j2"], ["tip", "lower"]).collect()
    assert len(got) == 8
    for r in got:
        a, b = 0.3 * r.frame_idx, -0.1 * r.frame_idx
        assert r.rpy == pytest.approx([0, 0, a + b], abs=1e-9)
        reach = 0.5 if r.ee_frame == "tip" else 0.0
        assert r.position[:2] == pytest.approx([math.cos(a) + reach * math.cos(a + b), math.sin(a) + reach * math.sin(a + b)])
    v = spark.createDataFrame([(0, i, [float(i), 9.0 if i == 3 else 1.0]) for i in range(8)], "e int, i int, v array<double>")
    assert {r.aperture for r in Ts.gripper_aperture(v, ["e"], "i", "v", "left", right=0, left=1, k=3).collect()} == {1.0}


def test_down_sampling():
    from kinegrain.functions.primitives import downsample

    x = np.arange(10.0)[:, None]
    assert downsample(x, 4)[:, 0].tolist() == [0, 3, 6, 9] and downsample(x, 10).tolist() == x.tolist() and downsample(x[:2], 4)[:, 0].tolist() == [0, 1, 1, 1]
