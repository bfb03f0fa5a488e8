"""Operators on dirty recordings: anomalies, compaction, schema drift, grids."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrain.operators import anomalies as A
from kinegrain.operators import compaction as C
from kinegrain.operators import drift as D
from kinegrain.operators import gridfill as G
from kinegrain.plans.data_queries import p4_headers
from kinegrain.sources.tables import resolve_episodes

FRAMES = "file_id bigint, episode_index bigint, frame_index bigint, robot_id string, timestamp double, `observation.state` array<double>, action array<double>, gripper array<double>"
FILES = "file_id bigint, file_path string"
EPISODES = "episode_index bigint, fps double, robot_id string"
ROBOTS = "robot_id string, model_name string"
LIMITS = "model_name string, field_name string, channel int, lower_limit double, upper_limit double"


def recording(episode, n, robot="r1", seed=0, file_id=None):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(0, 0.01, (n, 2)), axis=0) + rng.normal(0, 0.002, (n, 2))
    return [[file_id if file_id is not None else episode, episode, i, robot, i / 30, x[i].tolist(), [0.5, float(i // 20)], None] for i in range(n)]


def run(spark, rows, robots=(("r1", "m"),), limits=(("m", "observation.state", 0, -50.0, 50.0),), files=(), episodes=()):
    f = spark.createDataFrame([tuple(r) for r in rows], FRAMES)
    out = A.implausible(f, spark.createDataFrame(list(files), FILES), spark.createDataFrame(list(episodes), EPISODES), spark.createDataFrame(list(robots), ROBOTS), spark.createDataFrame(list(limits), LIMITS))
    return sorted((r.episode_index, r.frame_index, r.field_name, r.channel, r.kind) for r in out.collect())


def test_faults_are_found_and_normal_work_is_not(spark):
    rows = [r for e in range(12) for r in recording(e, 120, seed=e)]
    assert run(spark, rows) == []
    at = lambda e, i: rows[e * 120 + i]
    at(2, 50)[5][1] += 3.0  # spike of one frame
    at(3, 60)[5][0] -= 2.0
    at(3, 61)[5][0] -= 2.0  # of two
    at(4, 10)[5][0] = 99.0  # beyond its limit
    for i in range(30, 50):
        at(5, i)[5][1] = at(5, 30)[5][1]  # stuck
    for i in range(70, 120):
        at(6, i)[5][0] += 1.0  # a step to a new level
    at(7, 5)[5] = None
    at(7, 6)[5][0] = float("nan")
    at(7, 7)[5][0] = None
    at(8, 9)[5][0] = float("inf")
    want = [(2, 50, "observation.state", 1, "spike"), (3, 60, "observation.state", 0, "spike"), (3, 61, "observation.state", 0, "spike"), (4, 10, "observation.state", 0, "range"), (8, 9, "observation.state", 0, "range")]
    want += [(5, i, "observation.state", 1, "stuck") for i in range(30, 50)]
    assert run(spark, rows) == sorted(want)
    # repeated frames, unknown robots and episodes that only the file name tells change nothing
    again = rows + [list(r) for r in rows[300:420]]
    for r in again[::7]:
        r[3] = None
    lost = [[1000 + r[1], None, *r[2:]] if r[1] == 2 else r for r in again]
    assert run(spark, lost, files=[(1002, "ds/data/episode_000002.parquet"), (1002, "ds/data/episode_000002.parquet")], episodes=[(2, None, "r1")]) == sorted(want)


def test_no_frames(spark):
    assert run(spark, []) == []
    assert run(spark, [[1, None, 0, "r1", 0.0, [1.0], None, None], [1, 5, None, "r1", 0.0, [1.0], None, None], [1, 5, 0, None, 0.0, None, None, None]]) == []


def test_long_recordings_are_cut(spark, monkeypatch):
    rows = recording(0, 400, seed=1)
    rows[200][5][0] += 4.0
    rows[128][5][1] += 4.0
    whole = run(spark, rows)
    monkeypatch.setattr(A, "BLOCK", 128)
    monkeypatch.setattr(A, "HALO", 40)
    assert run(spark, rows) == whole and len(whole) == 2


def planted(seed, n_recordings=40, n=400):
    """Recordings of one robot whose channels move, are driven in steps, rest all at once or are fixed, and the faults planted in them."""
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for e in range(n_recordings):
        x = np.empty((n, 4))
        x[:, 0] = np.cumsum(rng.normal(0, 0.05, n)) + rng.normal(0, 0.01, n)
        at = np.cumsum(rng.integers(8, 45, n))
        x[:, 1] = np.round(rng.normal(0, 1, n), 3)[np.searchsorted(at, np.arange(n), side="right")]
        rest = np.zeros(n, bool)
        for a in rng.integers(10, n - 90, 3):
            rest[a : a + int(rng.integers(15, 61))] = True
        x[:, 2] = np.cumsum(np.where(rest, 0.0, rng.normal(0, 0.05, n)))
        x[:, 3] = 1.25
        used = np.zeros(n, bool)
        for ch in range(4):
            for a in rng.integers(10, n - 90, 1 if e % 2 else 0):
                k = int(rng.integers(1, 4))
                if not used[a - 6 : a + k + 6].any() and (ch != 1 or x[a - 1, 1] == x[a + k, 1]):
                    used[a : a + k] = True
                    x[a : a + k, ch] += rng.choice([-1, 1]) * rng.uniform(1.0, 4.0)
                    truth |= {(e, a + i, ch): "spike" for i in range(k)}
        if e % 20 == 0:
            a, k = int(rng.integers(10, n - 90)), int(rng.integers(16, 61))
            if not used[a - 6 : a + k + 6].any():
                x[a : a + k, 0] = x[a, 0]
                truth |= {(e, a + i, 0): "stuck" for i in range(k)}
        if e % 5 == 0:
            a = int(rng.integers(10, n - 90))
            if not used[a - 6 : a + 6].any() and (e, a, 0) not in truth:
                x[a, 0] = -9999.0
                truth[e, a, 0] = "range"
        rows += [[e, e, i, "r1", i / 30, x[i].tolist(), None, None] for i in range(n)]
    return rows, truth


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_faults_are_told_from_steps_rests_and_fixed_channels(spark, seed):
    rows, truth = planted(seed)
    limits = [("m", "observation.state", ch, -100.0, 100.0) for ch in range(4)]
    found = {(e, i, ch): kind for e, i, _, ch, kind in run(spark, rows, limits=limits)}
    for kind in ("spike", "stuck", "range"):
        want, got = {k for k, v in truth.items() if v == kind}, {k for k, v in found.items() if v == kind}
        assert want and len(want & got) >= 0.97 * len(want), kind
        assert len(want & got) >= 0.97 * len(got), kind


def test_any_number_of_channels(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(0, 0.01, (3, 60, 300)), axis=1)
    x[1, 30, 290] += 5.0
    rows = [[e, e, i, "r1", i / 30, x[e, i].tolist(), [0.1], [0.2, 0.3]] for e in range(3) for i in range(60)]
    assert run(spark, rows) == [(1, 30, "observation.state", 290, "spike")]


def test_rests_longer_than_the_context_of_a_block(spark, monkeypatch):
    """A source that usually rests for 60 readings gets stuck beyond 150, though a block shows less of the run."""
    rng = np.random.default_rng(4)
    rows = []
    for e in range(25):
        x = np.cumsum(rng.normal(0, 0.05, 700))
        x[100:160] = x[100]
        x[500:560] = x[500]
        if e == 3:
            x[230:420] = x[230]
        if e == 4:
            x[230:370] = x[230]
        rows += [[e, e, i, "r1", i / 30, [float(x[i])], None, None] for i in range(700)]
    want = [(3, i, "observation.state", 0, "stuck") for i in range(230, 420)]
    assert run(spark, rows) == want
    monkeypatch.setattr(A, "BLOCK", 64)
    monkeypatch.setattr(A, "HALO", 16)
    packed = A.pack_frames(spark.createDataFrame([tuple(r) for r in rows], FRAMES), spark.createDataFrame([], FILES), spark.createDataFrame([], EPISODES))
    params = spark.createDataFrame([("r1", [(0, 0.2, 150.0, None, None)])], "source string, params array<struct<ch:bigint,scale:double,still:double,low:double,high:double>>")
    runs = {(r.episode_index, r.block): r.runs[0] for r in A.crossing_runs(packed, params).collect()}
    assert runs[3, 3].trail == 190 and runs[3, 4].lead == runs[3, 4].trail == 190 and runs[3, 6].lead == 190 and runs[3, 6].trail == 1
    assert runs[4, 4].lead == 140 and runs[0, 0].lead == 1


def test_posteriors_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    logb = rng.normal(0, 3, (1, 5, 4))
    moved = np.array([[1, 0, 1, 0, 0.0]])
    apart = np.array([[1, 1, 0, 1, 1.0]])
    p = A.posteriors(logb, moved, apart, np.array([5]))
    total = np.zeros((5, 4))
    for path in itertools.product(range(4), repeat=5):
        if any((a == b == 2 and moved[0, t + 1]) or ((a == 2) != (b == 2) and not moved[0, t + 1]) for t, (a, b) in enumerate(zip(path[:-1], path[1:], strict=True))):
            continue
        steps = [A._A[0, 1] if a == b == 1 and apart[0, t + 1] else A._A[a, b] for t, (a, b) in enumerate(zip(path[:-1], path[1:], strict=True))]
        w = A._P0[path[0]] + sum(logb[0, t, s] for t, s in enumerate(path)) + sum(steps) + A._P1[path[-1]]
        for t, s in enumerate(path):
            total[t, s] += math.exp(w)
    assert p[0] == pytest.approx(total / total.sum(axis=1, keepdims=True), abs=1e-9)


# ---- compaction ------------------------------------------------------------------------------


def test_compaction_keeps_every_record(spark, tmp_path):
    rows = [(f, e, i, float(e * i)) for e in range(20) for i in range(30) for f in ([e] if i % 5 else [e, 100 + e, e])] + [(7, None, 1, 1.0), (8, None, 1, 2.0), (8, None, 1, 2.0)]
    df = spark.createDataFrame(rows, "file_id bigint, e bigint, i bigint, v double")
    target = str(tmp_path / "big")
    out = C.compact(df, ["e", "i"], "file_id", target, total_bytes=1000, target_bytes=300)
    got = out.collect()
    assert len([r for r in got if r.e is not None]) == 600 and sum(r.n_rows for r in got) == len(rows)
    assert {(r.e, r.i) for r in got if r.n_files > 1} == {(e, i) for e in range(20) for i in range(0, 30, 5)}
    assert sorted(r.v for r in got if r.e is None) == [1.0, 2.0]
    assert 1 < len(list((tmp_path / "big").glob("*.parquet"))) <= 4
    # a second run takes the place of the first
    again = C.compact(df.where("e < 3"), ["e", "i"], "file_id", target)
    assert again.count() == 90 and not list(tmp_path.glob("big.*"))
    assert C.compact(df.limit(0), ["e", "i"], "file_id", str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        C.compact(df.withColumnRenamed("v", "n_rows"), ["e", "i"], "file_id", target)


def test_compaction_notices_losses(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "file_id int, e int, i int")
    target = str(tmp_path / "t")
    C.compact(df, ["e", "i"], "file_id", target)
    real = C._summary
    monkeypatch.setattr(C, "_summary", lambda d, k, w: (real(d, k, w)[0] + (w is None), 0))
    with pytest.raises(RuntimeError):
        C.compact(df.limit(1), ["e", "i"], "file_id", target)
    assert spark.read.parquet(target).count() == 2 and not list(tmp_path.glob("t.*"))


def test_episodes_of_file_names(spark):
    f = spark.createDataFrame([(1, 5, 0, "a"), (2, None, 1, "b"), (3, None, 2, "c"), (None, None, 3, "d")], "file_id bigint, episode_index bigint, frame_index bigint, x string")
    names = spark.createDataFrame([(2, "d/episode_000.parquet"), (2, "d/episode_000.parquet"), (3, "d/file-7.parquet")], FILES)
    got = {r.x: r.episode_index for r in resolve_episodes(f, names, ["episode_index", "x"]).collect()}
    assert got == {"a": 5, "b": 0, "c": None, "d": None}


def test_a_swap_that_was_cut_off_is_put_back(spark, tmp_path):
    target = str(tmp_path / "t")
    spark.range(3).write.parquet(target + ".old-1")
    assert C.recover(spark, target) and spark.read.parquet(target).count() == 3 and not C.recover(spark, target)


# ---- schema drift ----------------------------------------------------------------------------

ROLE_COLS = ", ".join(f"{r} string" for r in D.ROLES)
SCHEMAS = f"snapshot_id bigint, dataset_id string, inspected_at timestamp, layout string, {ROLE_COLS}, all_keys array<string>, all_types array<string>, loaded_at timestamp"


def snap(i, day, keys, types, layout="shared", state=None, grip=None, ds="d"):
    t = dt.datetime(2025, 1, 1) + dt.timedelta(days=day)
    return (i, ds, t, layout, state, None, None, grip, None, None, None, keys, types, t)


def changes(spark, rows):
    return sorted((r.dataset_id, r.snapshot_id, r.change_kind, r.key_name) for r in D.schema_changes(spark.createDataFrame(rows, SCHEMAS)).collect())


def test_changes(spark):
    rows = [
        snap(1, 0, ["state", " T"], ["array<double>", "double"], state="state"),
        snap(2, 10, None, None, "unknown"),
        snap(3, 40, ["t", "Robot_State ", "x"], ["float64", "list<float>", "int"], state="robot_state"),
        snap(4, 41, ["t", "robot_state"], ["float64", "array<float32>"], "parquet", state=" ROBOT_STATE"),
        snap(4, 41, ["t", "robot_state"], ["float64", "array<float32>"], "parquet", state=" ROBOT_STATE"),
        snap(9, 0, [], [], ds="e"),
        snap(10, 1, [None, "a"], ["int", None], None, ds="e"),
    ]
    got = changes(spark, [r for r in rows if r[1] == "d"])
    assert got == [("d", 3, "added", "x"), ("d", 3, "renamed", "robot_state"), ("d", 3, "retyped", "robot_state"), ("d", 4, "layout", "parquet"), ("d", 4, "removed", "x")]
    assert {c[2:] for c in map(tuple, changes_of(spark, [r for r in rows if r[1] == "e"]))} == {("added", ""), ("added", "a"), ("layout", None)}
    assert changes(spark, []) == []


def changes_of(spark, rows):
    return [(r.dataset_id, r.snapshot_id, r.change_kind, r.key_name) for r in D.schema_changes(spark.createDataFrame(rows, SCHEMAS)).collect()]


def test_a_swap_is_no_rename(spark):
    rows = [snap(1, 0, ["a", "b"], ["int", "int"], state="a"), snap(2, 1, ["a", "b"], ["int", "int"], state="b"), snap(3, 2, ["b", "c"], ["int", "int"], state="c")]
    assert changes(spark, rows) == [("d", 3, "added", "c"), ("d", 3, "removed", "a")]


def test_lattice():
    kinds = ["int", "bigint", "float", "double", "boolean", "string", "array<float>", "array<double>", "array<int>", None]
    for a in kinds:
        assert D.promote(a, a) == a
        for b in kinds:
            assert D.promote(a, b) == D.promote(b, a)
            for c in kinds:
                assert D.promote(D.promote(a, b), c) == D.promote(a, D.promote(b, c))


def test_rows_of_one_table(spark):
    schemas = spark.createDataFrame([snap(1, 0, ["State", "n"], ["array<float>", "int"], state="state"), snap(2, 1, ["q", "n"], ["array<double>", "bigint"], state="q")], SCHEMAS)
    rows = spark.createDataFrame([(1, "d", 1, 0, '{"State":[1.5,null],"n":3}'), (1, "d", 1, 0, '{"State":[1.5,null],"n":3}'), (2, "d", 2, 0, '{"q":[2],"n":"x","more":1}'), (3, "d", 2, 1, '{"q":[2'), (4, "d", 9, 0, None)], "row_id bigint, dataset_id string, snapshot_id bigint, line_no int, record_json string")
    got = {r.row_id: r for r in D.consistent_rows(rows, schemas).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].state == [1.5, None] and got[1].n == 3 and got[1].role_joint_state == "[1.5,null]"
    assert got[2].q == [2.0] and got[2].n is None and got[2].state is None
    assert got[3].broken and got[3].q is None and got[4].broken
    assert got[2].lost == ["n"] and got[1].lost == [] and got[3].lost == []


def test_casts_keep_what_the_lattice_promises(spark):
    headers = [(["a", "b", "c", "d"], ["bool", "int", "int", "list<bool>"]), (["a", "b", "c", "d"], ["int64", "bigint", "float64", "array<int32>"])]
    schemas = spark.createDataFrame([snap(k, k, *h) for k, h in enumerate(headers)], SCHEMAS)
    text = ['{"a":true,"b":3.0,"c":9007199254740993,"d":[true,2,null]}', '{"a":7,"b":9007199254740993,"c":2.5,"d":[false,"x"]}', '{"a":"no","b":3.5,"c":null,"d":5}']
    rows = spark.createDataFrame([(k, "d", 1, k, t) for k, t in enumerate(text)], "row_id bigint, dataset_id string, snapshot_id bigint, line_no int, record_json string")
    got = {r.row_id: r for r in D.consistent_rows(rows, schemas).collect()}
    assert (got[0].a, got[0].b, got[0].d) == (1, 3, [1, 2, None]) and got[0].lost == ["c"]
    assert (got[1].a, got[1].b, got[1].c, got[1].d) == (7, 9007199254740993, 2.5, [0, None]) and got[1].lost == ["d"]
    assert (got[2].a, got[2].b, got[2].c, got[2].d) == (None, None, None, None) and got[2].lost == ["a", "b", "d"]
    cells = {(r.row_id, r.key_name): (r.value, r.lost) for r in D.consistent_cells(rows, schemas).collect()}
    assert cells[0, "a"] == ("1", False) and cells[0, "d"] == ("[1,2,null]", False) and cells[2, "b"] == (None, True)
    assert {r.key_name: (r.n_values, r.n_lost) for r in D.lost_values(rows, schemas).collect()} == {"a": (3, 1), "b": (3, 1), "c": (3, 1), "d": (3, 2)}
    with pytest.raises(ValueError, match="consistent_cells"):
        D.consistent_rows(rows, schemas, most_keys=3)


def test_keys_and_columns_with_clashing_names(spark):
    schemas = spark.createDataFrame([snap(1, 0, ["lost", "field_lost", "row_id", "a.b"], ["int", "int", "string", "int"])], SCHEMAS)
    rows = spark.createDataFrame([(1, "d", 1, 0, '{"lost":3,"field_lost":4,"row_id":"x","a.b":5}', "q", "r")], "row_id bigint, dataset_id string, snapshot_id bigint, line_no int, record_json string, joint_state_key string, keys string")
    r = D.consistent_rows(rows, schemas).collect()[0].asDict()
    assert (r["row_id"], r["lost"], r["field_field_lost"], r["field_lost"], r["field_row_id"], r["a.b"]) == (1, [], 3, 4, "x", 5)


def test_lattice_of_columns_is_that_of_names(spark):
    kinds = [*sorted(set(D.SPELLINGS.values())), "array<int>", "array<boolean>", "array<array<float>>", "date"]
    pairs = spark.createDataFrame([(a, b) for a in [*kinds, "null"] for b in [*kinds, "null"]], "a string, b string")
    for r in pairs.select("a", "b", D.promote_types(F.col("a"), F.col("b")).alias("met")).collect():
        none = lambda t: None if t == "null" else t
        assert r.met == (D.promote(none(r.a), none(r.b)) or "null"), r


def test_verdicts(spark):
    types = ["int", "bigint", "int", "string", "float32", "int"]
    schemas = spark.createDataFrame([snap(k, k, ["x"], [t]) for k, t in enumerate(types)], SCHEMAS)
    got = [(r.was, r.now, r.verdict) for r in D.schema_changes(schemas).orderBy("snapshot_id").collect()]
    assert got == [("int", "bigint", "widened"), ("bigint", "int", "narrowed"), ("int", "string", "widened"), ("string", "float", "narrowed"), ("float", "int", "merged")]


def test_headers(spark, tmp_path):
    spark.range(3).selectExpr("id", "array(cast(id as float)) as a", "true as b", "date'2020-01-01' as c").coalesce(1).write.parquet(str(tmp_path / "deep" / "er" / "p"))
    spark.range(3).selectExpr("cast(id as int) as id", "1.5D as a").coalesce(1).write.parquet(str(tmp_path / "q"))
    (tmp_path / "broken.parquet").write_bytes(b"no parquet")
    files = D.list_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 2)[-2]: (r["keys"], r.types) for r in D.read_headers(files).collect()}
    assert got["p"] == (["id", "a", "b", "c"], ["bigint", "array<float>", "boolean", "date"]) and got["q"] == (["id", "a"], ["int", "double"])
    assert [v for k, v in got.items() if k not in "pq"] == [(None, None)]
    cells = D.read_headers(files).select(F.explode(F.arrays_zip("keys", "types")).alias("z")).select(F.col("z.keys").alias("key_name"), F.col("z.types").alias("type"))
    assert {r.key_name: r.key_type for r in D.fold_types(cells).collect()} == {"id": "bigint", "a": "string", "b": "boolean", "c": "date"}


def test_headers_that_cannot_be_read_are_no_result(spark, tmp_path):
    for name in ("a b", "a%41", "c#d", "e?f", "ü"):
        (tmp_path / name).mkdir()
        spark.range(3).selectExpr(f"id as `k{name}`").toPandas().to_parquet(str(tmp_path / name / "x.parquet"))
    headers = D.read_headers(D.list_files(spark, str(tmp_path)))
    assert {r.path.rsplit("/", 2)[-2]: (r["keys"], r.error) for r in headers.collect()} == {n: ([f"k{n}"], None) for n in ("a b", "a%41", "c#d", "e?f", "ü")}
    assert p4_headers(spark, str(tmp_path)).count() == 5
    (tmp_path / "broken.parquet").write_bytes(b"no parquet")
    elsewhere = spark.createDataFrame([(f"file://{tmp_path}/gone.parquet",), ("nowhere://a/b.parquet",), (None,)], "path string")
    got = {r.path and r.path.rsplit("/", 1)[-1]: (r["keys"], r.error) for r in D.read_headers(D.list_files(spark, str(tmp_path)).where("path like '%broken%'").union(elsewhere)).collect()}
    assert got.keys() == {"broken.parquet", "gone.parquet", "b.parquet", None} and all(k is None and e for k, e in got.values())
    assert "FileNotFoundError" in got["gone.parquet"][1] and "nowhere" in got["b.parquet"][1]
    with pytest.raises(Exception, match="header can't be read.*broken.parquet"):
        p4_headers(spark, str(tmp_path)).collect()


# ---- grids -----------------------------------------------------------------------------------


def grid(spark, rows, files=(), episodes=()):
    f = spark.createDataFrame([tuple(r) for r in rows], FRAMES)
    return {(r.episode_index, r.slot_index): r for r in G.regular_grid(f, spark.createDataFrame(list(files), FILES), spark.createDataFrame(list(episodes), EPISODES)).collect()}


def wave(e, n, fps=10.0, start=100.0):
    return [[1, e, i, "r", start + i / fps, [math.sin(i / 5), math.cos(i / 7)], None, None] for i in range(n)]


def test_gaps_are_filled_and_marked(spark):
    rows = [r for r in wave(1, 80) if r[2] not in (20, 21, 50)]
    rows[5][5] = [None, float("nan")]
    rows[6][5] = [None, 0.5]
    rows[7][4] = None
    rows += [list(rows[9])]
    got = grid(spark, rows, episodes=[(1, 10.0, None), (1, 10.0, None)])
    assert sorted(s for (_, s), r in got.items() if r.filled) == [5, 7, 20, 21, 50]
    assert len(got) == 80 and all(None not in r.state for r in got.values())
    for s in (20, 21, 50):
        assert got[(1, s)].state == pytest.approx([math.sin(s / 5), math.cos(s / 7)], abs=0.05)
    assert got[(1, 6)].state[0] == pytest.approx(math.sin(6 / 5), abs=0.05) and got[(1, 6)].state[1] == 0.5
    assert got[(1, 9)].n_readings == 2


def test_piece_borders_lose_nothing(spark, monkeypatch):
    rows = [r for r in wave(1, 300, start=1.7e9 + 3) if not 90 < r[2] < 200 and r[2] % 11]
    whole = grid(spark, rows, episodes=[(1, 10.0, None)])
    monkeypatch.setattr(G, "PIECE", 2.0)
    monkeypatch.setattr(G, "HALO", 0.7)
    cut = grid(spark, rows, episodes=[(1, 10.0, None)])
    assert set(cut) == set(whole) and {k for k, r in cut.items() if r.filled} == {k for k, r in whole.items() if r.filled}


def test_grid_of_odd_inputs(spark):
    assert grid(spark, []) == {}
    got = grid(spark, [[1, 4, 0, "r", 0.0, None, None, None], [1, 4, 1, "r", 1.0, [1.0], None, None], [1, None, 1, "r", 1.0, [1.0], None, None]])
    assert list(got) == [(4, 30)] and not got[(4, 30)].filled
    far = grid(spark, [[1, 4, 0, "r", 0.0, [1.0], None, None], [1, 4, 1, "r", 4000.0, [3.0], None, None]])
    assert len(far) == 120001 and far[(4, 60000)].filled and 1.0 <= far[(4, 60000)].state[0] <= 3.0


def test_imputation_keeps_what_was_seen():
    t = np.arange(200)
    x = np.stack([np.sin(t / 6), np.cos(t / 9)], axis=1)
    y = x.copy()
    y[60:66, 0] = np.nan
    out, converged = G.ssa_fill(y)
    assert converged and np.array_equal(out[~np.isnan(y)], x[~np.isnan(y)]) and np.abs(out - x).max() < 0.1
    assert np.isnan(G.ssa_fill(np.full((9, 1), np.nan))[0]).all()


@pytest.mark.parametrize("gap", [10, 20, 30])
def test_long_gaps_are_iterated_to_the_end(gap):
    t = np.arange(600) / 30
    x = np.stack([np.sin((1 + k / 3) * t) + 0.5 * np.cos((2.3 - k / 5) * t) for k in range(6)], axis=1)
    x[200 : 200 + gap] = np.nan
    out, converged = G.ssa_fill(x)
    best, _ = G.ssa_fill(x, tolerance=1e-6)
    assert converged and np.abs(out - best).max() < 0.2 and not G.ssa_fill(x, rounds=5)[1]


def test_portions_of_a_piece_have_context(monkeypatch):
    rng = np.random.default_rng(0)
    slot = np.flatnonzero(rng.random(6000) > 0.2)
    slot = slot[(slot < 2000) | (slot > 2100)]
    state = np.stack([np.sin(slot / 30), np.cos(slot / 50)], axis=1)

    def filled():
        got = [b for b in G._fill_piece(1, 0.0, 30.0, None, slot, state, np.ones(len(slot), bool))]
        at = np.concatenate([b.column("slot_index").to_numpy() for b in got])
        assert np.array_equal(at, np.arange(slot[0], slot[-1] + 1))
        return np.array([v for b in got for v in b.column("state").to_pylist()])

    whole = filled()
    monkeypatch.setattr(G, "PORTION", 700)
    cut = filled()
    assert np.abs(cut - whole).max() < 0.02
