"""Datasets on disk, texts, streams and the entry contract."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinegrain.sources import datasets as S
from kinegrain.sources import texts as T


def make(spark, root, layout):
    (root / "meta").mkdir(parents=True)
    (root / "meta/info.json").write_text(json.dumps({"fps": 20, "features": {"observation.state": {"names": ["a", "b"]}, "action": {"names": [["c"], ["d"]]}}}))
    rows = [(e, i, [float(i), float(e)], [0.0, 1.0]) for e in (0, 1, 10) for i in range(4)]
    df = spark.createDataFrame(rows, "episode_index bigint, frame_index bigint, `observation.state` array<double>, action array<double>")
    if layout == "shared":
        df.toPandas().to_parquet(root / "data_tmp.parquet")
        (root / "data/chunk-000").mkdir(parents=True)
        (root / "data_tmp.parquet").rename(root / "data/chunk-000/file-000.parquet")
    else:
        (root / "data/chunk-000").mkdir(parents=True)
        p = df.toPandas()
        for e in (0, 1, 10):
            p[p.episode_index == e].drop(columns=["episode_index"]).to_parquet(root / f"data/chunk-000/episode_{e:06d}.parquet")
        (root / "meta/episodes.jsonl").write_text("\n".join(json.dumps({"episode_id": e, "length": 4}) for e in (10, 0, 1)) + "\n\n")
    return str(root)


@pytest.mark.parametrize("layout", ["shared", "per_episode"])
def test_datasets(spark, tmp_path, layout):
    root = make(spark, tmp_path / "ds", layout)
    s = S.inspect_dataset(spark, root)
    assert (s.layout, s.n_episodes, s.fps, s.joint_dim) == (layout, 3, 20.0, 2)
    assert s.state_names == ["a", "b"] and s.command_names == ["c", "d"] and s.state_names_from == "info_json"
    assert [r.episode_id for r in S.list_episodes(spark, s).collect()] == ["0", "1", "10"]
    f = S.load_frames(spark, s, 10)
    assert [r.t for r in f.orderBy("frame_idx").collect()] == [0.0, 0.05, 0.1, 0.15] and {r.episode_id for r in f.collect()} == {"10"}
    assert S.load_frames(spark, s).count() == 12


def test_cleaning_of_vectors(spark):
    d = spark.createDataFrame([("e", 0, 0.0, [None, None]), ("e", 1, 0.1, [1.0, 2.0]), ("e", 2, 0.2, [None, 3.0]), ("e", 3, 0.3, None)], "episode_id string, frame_idx int, t double, q array<double>")
    assert [r.q for r in S.clean_vectors(d, "ffill_drop", ["q"]).orderBy("frame_idx").collect()] == [[1.0, 2.0], [1.0, 3.0], [1.0, 3.0]]
    assert S.clean_vectors(d, "none", ["q"]).count() == 1


def test_missing_datasets(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.inspect_dataset(spark, str(tmp_path / "no"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        S.inspect_dataset(spark, str(tmp_path / "empty"))


def test_texts(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one two three\n\n  four \x0bfive\n")
    rows = T.text_lines(spark, str(tmp_path / "t.txt"), 2)
    assert [r.text for r in rows.collect()] == ["one two three", "four"]
    df = spark.createDataFrame([(0, "a b c d e"), (1, ""), (2, None), (3, "x\ty")], "k int, text string")
    got = {r.k: r for r in T.segment_texts(df, "k", "text").collect()}
    assert [sum(got[k].label_lengths.values()) for k in range(4)] == [5, 0, 0, 2] and got[1].segments[0].label == "empty"
    rng = random.Random(42)
    want = [T.segment_tokens(n, rng) for n in (5, 0, 0, 2)]
    serial = T.segment_texts(df, "k", "text", 42, per_row=False).orderBy("k").collect()
    assert [[s.asDict() for s in r.segments] for r in serial] == want


def test_stream(spark, tmp_path):
    from kinegrain.streaming.detect import stream_boundaries

    rows = [(1, i, v) for i, v in enumerate([1.0, 1.0, 0.0, 1.0, 1.0, 1.0])]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "episode int, s int, speed double").select("episode", F.timestamp_seconds("s").alias("at"), "speed").write.parquet(src)
    stream = spark.readStream.schema("episode int, at timestamp, speed double").parquet(src)
    q = stream_boundaries(stream, speed_change=0.5, stop_speed=0.1, hold=1.0).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.t, r.kind) for r in spark.table("found").collect())
    assert got == [(2.0, "jump"), (2.0, "stop"), (3.0, "jump"), (4.0, "stop")]


def test_contract(spark):
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60
    assert e.entry(spark).count() > 0


def test_command_line(spark, tmp_path):
    from kinegrain.cli import main

    (tmp_path / "t.txt").write_text("one two three\n\nfour five\n")
    assert main(["text", "--dataset-path", str(tmp_path / "t.txt"), "--output", str(tmp_path / "o.json")]) == 0
    assert [r["num_segments"] >= 1 for r in json.loads((tmp_path / "o.json").read_text())] == [True, True]
    assert main(["text", "--dataset-path", str(tmp_path / "t.txt"), "--output", str(tmp_path / "o.csv")]) == 0
    assert main(["text", "--dataset-path", str(tmp_path / "t.txt"), "--output", str(tmp_path / "o.xml")]) == 1
    root = make(spark, tmp_path / "ds", "shared")
    assert main(["dataset", "--dataset", root, "--n-episodes", "2", "--modalities", "joint", "ablation", "cartesian", "--output", str(tmp_path / "out")]) == 0
    text = (tmp_path / "out/report.md").read_text()
    assert "ablation is joint_command" in text and "skipped" in text and "## Runtimes" in text and "## Skipped" in text
    rows = spark.read.option("header", True).csv(str(tmp_path / "out/boundaries.csv")).collect()
    assert {(r.modality, r.status) for r in rows} == {("joint", "success"), ("joint_command", "success"), ("cartesian", "skipped")}
    assert all(r.method is None and r.reason for r in rows if r.modality == "cartesian") and {"pelt", "binseg"} < {r.method for r in rows if r.modality == "joint"}
    nested = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/results.json")).collect()]
    assert len(nested) == 2 and set(nested[0]["modalities"]) == {"joint", "joint_command", "cartesian"}
    joint = nested[0]["modalities"]["joint"]
    assert joint["status"] == "success" and joint["feature_names"][0] == "q_0" and len(joint["feature_names"]) == 3 * len([n for n in joint["feature_names"] if n.startswith("q_")]) and joint["primitives"]["status"] in ("success", "skipped")
    assert json.loads((tmp_path / "out/selected_episode_ids.json").read_text())["num_selected"] == 2


def test_configurations(tmp_path):
    from kinegrain import config as C

    (tmp_path / "c.yaml").write_text("ruptures: {cost_model: l2, penalty: 10, penalty_range: [1, 5], compare_algorithm: x}\ngripper: {closed: 0.5}\nticc: {enabled: false, n_clusters: 3}\n")
    cfg = C.read_yaml(str(tmp_path / "c.yaml"))
    assert C.change_config(cfg).model == "l2" and C.change_config(cfg).penalty_range == (1, 5) and C.phase_config(cfg).closed == 0.5
    assert C.primitive_config(cfg).k == 3 and not C.enabled(cfg, "ticc") and C.enabled(cfg, "sktime") and C.read_yaml(None) == {}
    assert C.modalities(["joint", "Joint", "ablation"]) == (["joint", "joint_command"], ["ablation is joint_command"])
