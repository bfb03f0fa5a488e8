"""Queries of the series operators with their SQL.

Stand-ins: a user's ``events`` are a recording (order: ts, event_id; seconds since the first; ``value`` as
signal and speed, at least 245 as closed gripper), an ``embeddings`` label's vectors are joint states.
Thresholds are scaled to these.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinegrain.operators import boundaries as B
from kinegrain.operators import timeseries as S
from kinegrain.operators.features import FeatureConfig, derivatives, grouped_matrix, grouped_positions, joint_command_columns, scale_columns
from kinegrain.operators.rotation import matrix_to_quat, quat_to_rotvec, unwrap_rotvecs
from kinegrain.sources.tables import table

E = ["episode"]
CHANGE, STOP, HOLD, GRIP, GAP, LEAST = 150.0, 30.0, 20000.0, 0.5, 50000.0, 20000.0
PHASE = B.PhaseConfig(closed=200.0, opened=40.0, grip_dwell=2, moving=20.0, still=60.0, speed_dwell=2)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, frame, t, x, speed, gripper, event_type."""
    ev = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id")
    return ev.select(
        F.col("user_id").alias("episode"), (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("bigint").alias("frame"), ((us - F.min(us).over(w)) / 1e6).alias("t"),
        F.col("value").alias("x"), F.col("value").alias("speed"), F.when(F.col("value") >= 245, 1.0).otherwise(0.0).alias("gripper"), "event_type", "event_id",
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


def joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    frame = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("bigint").alias("episode"), frame.cast("bigint").alias("frame"), (frame / 30.0).alias("t"), F.slice(v, 1, 44).alias("q"), F.slice(v, 21, 44).alias("q_cmd"), F.slice(v, 1, 7).alias("ee_pose"))


EV = """ev AS (SELECT user_id AS episode, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, value AS x, value AS speed, CASE WHEN value >= 245 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gripper, event_type, event_id FROM events)"""
RULES = f"""{EV},
  m AS (SELECT *, lag(speed) OVER w AS ps, lag(gripper >= {GRIP}) OVER w AS pg, coalesce(t <= last_value(CASE WHEN speed <= {STOP} THEN t END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) + {HOLD}, false) AS held
        FROM ev WINDOW w AS (PARTITION BY episode ORDER BY frame)),
  h AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY episode ORDER BY frame), false) AS ph FROM m),
  rb AS (SELECT DISTINCT episode, frame, t FROM h WHERE coalesce(abs(speed - ps) >= {CHANGE}, false) OR held <> ph OR coalesce(pg <> (gripper >= {GRIP}), false))"""
MERGED = f"""{RULES},
  sp AS (SELECT episode, min(frame) AS a, max(frame) AS b FROM ev GROUP BY 1),
  inner_b AS (SELECT rb.* FROM rb JOIN sp USING (episode) WHERE frame > a AND frame < b),
  folded AS (SELECT episode, list_reduce(list({{'i': frame, 't': t}} ORDER BY frame), lambda acc, s: CASE WHEN len(acc) = 0 OR s.t - acc[-1].t >= {GAP} THEN list_append(acc, s) ELSE acc END, CAST([] AS STRUCT(i BIGINT, t DOUBLE)[])) AS k FROM inner_b GROUP BY 1),
  mb AS (SELECT sp.episode, a, b, coalesce(list_transform(k, lambda s: s.i), CAST([] AS BIGINT[])) AS boundaries FROM sp LEFT JOIN folded USING (episode))"""
SEGS = f"""{MERGED},
  cuts AS (SELECT episode, unnest(list_distinct(list_concat([a, b], boundaries))) AS frame FROM mb),
  sg AS (SELECT episode, start_t, end_t, CAST(row_number() OVER (PARTITION BY episode ORDER BY start_t) - 1 AS INTEGER) AS seg_id FROM
    (SELECT episode, t AS start_t, lead(t) OVER (PARTITION BY episode ORDER BY frame) AS end_t FROM cuts JOIN ev USING (episode, frame)) WHERE end_t - start_t >= {LEAST})"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = trajectories(spark, d)
    return t, B.rule_boundaries(t, E, "frame", CHANGE, STOP, HOLD, GRIP)


def merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, found = rules(spark, d)
    return t, B.merge_boundaries(found, t, E, "frame", GAP)


def segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, m = merged(spark, d)
    return t, B.boundary_segments(m, t, E, "frame", LEAST)


@query(f"WITH {RULES} SELECT episode, frame FROM rb")
def rule_boundaries(spark, d):
    return rules(spark, d)[1]


@query(f"WITH {MERGED} SELECT episode, array_to_string(boundaries, ';') AS boundary_frames FROM mb")
def merged_boundaries(spark, d):
    from kinegrain.operators.report import boundary_strings

    return boundary_strings(merged(spark, d)[1], E)


@query(f"WITH {SEGS} SELECT episode, seg_id, round(start_t, 6) AS start_t, round(end_t, 6) AS end_t FROM sg")
def boundary_segments(spark, d):
    return rounded(segments(spark, d)[1], "start_t", "end_t")


@query(f"WITH {RULES} SELECT episode, frame, held FROM h")
def hysteresis(spark, d):
    return B.hysteresis(trajectories(spark, d), E, "frame", F.col("speed") <= STOP, HOLD).select("episode", "frame", "held")


def _holed(spark, d):
    return trajectories(spark, d).withColumn("x", F.when(F.col("event_id") % 7 != 0, F.col("x")))


HOLED = f"{EV}, hv AS (SELECT episode, frame, t, CASE WHEN event_id % 7 <> 0 THEN x END AS x FROM ev)"


@query(f"WITH {HOLED} SELECT * FROM (SELECT episode, frame, last_value(x IGNORE NULLS) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS x FROM hv) WHERE x IS NOT NULL")
def ffill_drop(spark, d):
    return S.clean_rows(_holed(spark, d).select("episode", "frame", "x"), E, "frame", ["x"])


@query(f"WITH {HOLED} SELECT episode, frame, x FROM hv WHERE x IS NOT NULL")
def drop_missing(spark, d):
    return S.clean_rows(_holed(spark, d).select("episode", "frame", "x"), E, "frame", ["x"], "none")


@query(f"WITH {EV}, s AS (SELECT episode, t - lag(t) OVER (PARTITION BY episode ORDER BY frame) AS d FROM ev) SELECT episode, round(median(CASE WHEN d > 0 THEN d END), 6) AS dt FROM s GROUP BY 1")
def median_dt(spark, d):
    return rounded(S.median_dt(trajectories(spark, d), E, "frame"), "dt")


@query(f"WITH {EV}, s AS (SELECT episode, t - lag(t) OVER (PARTITION BY episode ORDER BY frame) AS d FROM ev) SELECT episode, round(CASE WHEN median(d) > 0 THEN 1 / median(d) ELSE 30 END, 9) AS fps FROM s GROUP BY 1")
def fps_from_times(spark, d):
    from kinegrain.operators.evaluation import fps_of

    return rounded(fps_of(trajectories(spark, d), E, "frame"), "fps", digits=9)


@query(f"WITH {EV}, s AS (SELECT episode, frame, t - lag(t) OVER (PARTITION BY episode ORDER BY frame) AS d FROM ev) SELECT episode, CASE WHEN count(*) < 2 OR min(d) <= 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN count(*) < 2 THEN 'fewer than two rows' WHEN min(d) <= 0 THEN 'times don''t rise' END AS reason FROM s GROUP BY 1")
def resample_status(spark, d):
    return S.resample_status(trajectories(spark, d), E, "frame")


RES = f"""{EV},
  s0 AS (SELECT episode, frame, t, x, t - lag(t) OVER (PARTITION BY episode ORDER BY frame) AS d FROM ev),
  s1 AS (SELECT *, median(CASE WHEN d > 0 THEN d END) OVER (PARTITION BY episode) AS dt, max(CASE WHEN d <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY episode) AS bad, count(*) OVER (PARTITION BY episode) AS n FROM s0),
  s2 AS (SELECT *, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM s1 WHERE bad = 0 AND n > 1 AND dt > 0 WINDOW w AS (PARTITION BY episode ORDER BY frame)),
  s3 AS (SELECT *, unnest(range(CAST(ceil(t / dt) AS BIGINT), CASE WHEN t1 IS NULL THEN CAST(ceil((t + 0.5 * dt) / dt) AS BIGINT) ELSE CAST(ceil(t1 / dt) AS BIGINT) END)) AS k FROM s2),
  rs AS (SELECT episode, k, k * dt AS t, CASE WHEN t1 IS NULL THEN x ELSE x + (x1 - x) * ((k * dt - t) / (t1 - t)) END AS x, dt FROM s3)"""


@query(f"WITH {RES} SELECT episode, k, round(t, 4) AS t, round(x, 6) AS x FROM rs")
def resample_linear(spark, d):
    r = S.resample_linear(trajectories(spark, d), E, "frame", ["x"])
    return rounded(rounded(r.select("episode", "k", "t", "x"), "t", digits=4), "x")


def _grad(col: str, table_: str, order: str, dt: str) -> str:
    return f"CASE WHEN lag({col}) OVER w IS NULL AND lead({col}) OVER w IS NULL THEN 0 WHEN lag({col}) OVER w IS NULL THEN (lead({col}) OVER w - {col}) / {dt} WHEN lead({col}) OVER w IS NULL THEN ({col} - lag({col}) OVER w) / {dt} ELSE (lead({col}) OVER w - lag({col}) OVER w) / (2 * {dt}) END"


@query(f"WITH {EV} SELECT episode, frame, round({_grad('x', 'ev', 'frame', '1.0')}, 6) AS dx FROM ev WINDOW w AS (PARTITION BY episode ORDER BY frame)")
def gradient(spark, d):
    return rounded(S.gradient(trajectories(spark, d), E, "frame", "x", "dx").select("episode", "frame", "dx"), "dx")


def _scaled(method: str) -> str:
    spread = "1.4826 * median(abs(x - m)) OVER (PARTITION BY episode)" if method == "mad" else "quantile_cont(x, 0.75) OVER (PARTITION BY episode) - quantile_cont(x, 0.25) OVER (PARTITION BY episode)"
    return f"WITH {EV}, a AS (SELECT *, median(x) OVER (PARTITION BY episode) AS m FROM ev), b AS (SELECT *, {spread} AS s FROM a) SELECT episode, frame, round((x - m) / CASE WHEN abs(s) < 1e-8 THEN 1 ELSE s END, 6) AS x FROM b"


@query(_scaled("mad"))
def robust_scale_mad(spark, d):
    return rounded(S.robust_scale(trajectories(spark, d), E, "x", "mad").select("episode", "frame", "x"), "x")


@query(_scaled("iqr"))
def robust_scale_iqr(spark, d):
    return rounded(S.robust_scale(trajectories(spark, d), E, "x", "iqr").select("episode", "frame", "x"), "x")


# ---- stencils --------------------------------------------------------------------------------


def _offsets(weights: list[float], boundary: str, reducer: str) -> str:
    r = len(weights) // 2
    at = "greatest(0, least(n - 1, p.frame + o.o))" if boundary == "clamp" else "CASE WHEN ((p.frame + o.o) % (2 * n) + 2 * n) % (2 * n) < n THEN ((p.frame + o.o) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((p.frame + o.o) % (2 * n) + 2 * n) % (2 * n) END"
    values = ", ".join(f"({k - r}, {w!r}::DOUBLE)" for k, w in enumerate(weights))
    agg = "sum(q.x * o.w)" if reducer == "dot" else "median(q.x)"
    return f"o(o, w) AS (VALUES {values}), p AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM src), st AS (SELECT p.episode, p.frame, {agg} AS y FROM p CROSS JOIN o JOIN src q ON q.episode = p.episode AND q.frame = {at} GROUP BY 1, 2)"


def _stencil_sql(weights: list[float], boundary: str, reducer: str) -> str:
    return f"WITH {EV}, src AS (SELECT episode, frame, x FROM ev), {_offsets(weights, boundary, reducer)} SELECT episode, frame, round(y, 6) AS x FROM st"


@query(_stencil_sql([0.2] * 5, "clamp", "dot"))
def moving_average(spark, d):
    return rounded(S.moving_average(trajectories(spark, d), E, "frame", "x", 5).select("episode", "frame", "x"), "x")


@query(_stencil_sql([1.0] * 5, "reflect", "median"))
def median_filter(spark, d):
    return rounded(S.median_filter(trajectories(spark, d), E, "frame", "x", 5).select("episode", "frame", "x"), "x")


@query(_stencil_sql(S.gaussian_weights(3.0), "reflect", "dot"))
def gaussian_smooth(spark, d):
    return rounded(S.gaussian_smooth(trajectories(spark, d), E, "frame", "x", 3.0).select("episode", "frame", "x"), "x")


def _savgol_sql(window: int = 11, order: int = 3) -> str:
    rows = ", ".join(f"({p}, {k}, {float(w)!r}::DOUBLE)" for p, r in enumerate(S.savgol_matrix(window, order)) for k, w in enumerate(r))
    h = window // 2
    return f"""WITH {EV}, w(p, k, w) AS (VALUES {rows}), a AS (SELECT episode, frame, x, count(*) OVER (PARTITION BY episode) AS n FROM ev),
  b AS (SELECT *, CASE WHEN frame < {h} THEN frame WHEN frame >= n - {h} THEN {window} - (n - frame) ELSE {h} END AS p, greatest(0, least(n - {window}, frame - {h})) AS s FROM a)
SELECT b.episode, b.frame, round(sum(w.w * v.x), 6) AS x FROM b JOIN w USING (p) JOIN ev v ON v.episode = b.episode AND v.frame = b.s + w.k GROUP BY 1, 2"""


@query(_savgol_sql())
def savgol(spark, d):
    return rounded(S.savgol(trajectories(spark, d), E, "frame", "x").select("episode", "frame", "x"), "x")


def _speed_sql() -> str:
    first = _offsets(S.gaussian_weights(3.0), "reflect", "dot")
    again = _offsets(S.gaussian_weights(5.0), "reflect", "dot").replace("o(o, w)", "o2(o, w)").replace("CROSS JOIN o JOIN", "CROSS JOIN o2 o JOIN").replace("p AS (", "p2 AS (").replace("FROM p ", "FROM p2 p ").replace("src", "sv").replace("st AS", "st2 AS")
    return f"""WITH {EV}, src AS (SELECT episode, frame, x FROM ev), {first},
  v AS (SELECT st.episode, st.frame, (lead(y) OVER w - y) / CASE WHEN lead(t) OVER w - t = 0 THEN 1e-6 ELSE lead(t) OVER w - t END AS v FROM st JOIN ev USING (episode, frame) WINDOW w AS (PARTITION BY st.episode ORDER BY st.frame)),
  sv AS (SELECT episode, frame, abs(coalesce(v, lag(v) OVER (PARTITION BY episode ORDER BY frame), 0)) AS x FROM v), {again}
SELECT episode, frame, round(y, 9) AS speed FROM st2"""


@query(_speed_sql())
def gaussian_speed(spark, d):
    t = trajectories(spark, d).drop("speed")
    return rounded(S.effector_speed(t, E, "frame", ["x"]).select("episode", "frame", "speed"), "speed", digits=9)


# ---- features --------------------------------------------------------------------------------

PLAIN = FeatureConfig(smoothing="none")


def _scale_sql(cols: list[str], src: str) -> str:
    a = ", ".join(f"median({c}) OVER (PARTITION BY episode) AS m_{c}" for c in cols)
    b = ", ".join(f"1.4826 * median(abs({c} - m_{c})) OVER (PARTITION BY episode) AS s_{c}" for c in cols)
    out = ", ".join(f"round(({c} - m_{c}) / CASE WHEN abs(s_{c}) < 1e-8 THEN 1 ELSE s_{c} END, 5) AS {c}" for c in cols)
    return f"ma AS (SELECT *, {a} FROM {src}), mb2 AS (SELECT *, {b} FROM ma) SELECT episode, k, {out} FROM mb2"


JF = f"""{RES}, g1 AS (SELECT *, x AS q, {_grad("x", "rs", "k", "dt")} AS d_q FROM rs WINDOW w AS (PARTITION BY episode ORDER BY k)),
  g2 AS (SELECT *, {_grad("d_q", "g1", "k", "dt")} AS dd_q FROM g1 WINDOW w AS (PARTITION BY episode ORDER BY k))"""


@query(f"WITH {JF}, {_scale_sql(['q', 'd_q', 'dd_q'], 'g2')}")
def joint_features(spark, d):
    t = trajectories(spark, d).withColumnRenamed("x", "q")
    f = scale_columns(derivatives(t, E, ["q"], PLAIN), E, {c: "joint" for c in ("q", "d_q", "dd_q")}, PLAIN)
    return rounded(f.select("episode", "k", "q", "d_q", "dd_q"), "q", "d_q", "dd_q", digits=5)


RES2 = RES.replace("value AS x,", "value AS x0, value AS x,").replace("SELECT episode, frame, t, x, t - lag", "SELECT episode, frame, t, x, coalesce(lead(x) OVER (PARTITION BY episode ORDER BY frame), x) AS c, t - lag").replace("lead(x) OVER w AS x1", "lead(x) OVER w AS x1, lead(c) OVER w AS c1")
RES2 = RES2.replace("/ (t1 - t)) END AS x, dt FROM s3", "/ (t1 - t)) END AS x, CASE WHEN t1 IS NULL THEN c ELSE c + (c1 - c) * ((k * dt - t) / (t1 - t)) END AS q_cmd, dt FROM s3")
JCF = JF.replace(RES, RES2).replace("SELECT *, x AS q,", "SELECT *, x AS q, q_cmd - x AS err_q,")


@query(f"WITH {JCF}, {_scale_sql(['q', 'd_q', 'dd_q', 'q_cmd', 'err_q'], 'g2')}")
def joint_command_features(spark, d):
    w = Window.partitionBy("episode").orderBy("frame")
    t = trajectories(spark, d).withColumn("q_cmd", F.coalesce(F.lead("x").over(w), "x")).withColumnRenamed("x", "q")
    r = S.resample_linear(t, E, "frame", ["q", "q_cmd"])
    r = S.gradient(S.gradient(r, E, "k", "q", "d_q", F.col("dt")), E, "k", "d_q", "dd_q", F.col("dt"))
    cols = ["q", "d_q", "dd_q", "q_cmd", "err_q"]
    r = scale_columns(joint_command_columns(r, ["q"], ["q_cmd"]), E, {c: "joint" if c in cols[:3] else "command" for c in cols}, PLAIN)
    return rounded(r.select("episode", "k", *cols), *cols, digits=5)


# fixed values: the 44 channels of a two-armed robot by group
LAYOUT = {"torso": range(0, 6), "right_arm": range(6, 13), "left_arm": range(13, 20), "right_gripper": range(20, 32), "left_gripper": range(32, 44)}
NAMES = [f"{g}_{j}" for g, own in LAYOUT.items() for j in range(len(own))]
GROUPS = {g: [*[f"{g}_{j}" for j in range(len(own))], "unknown_joint"] for g, own in LAYOUT.items()}


@query(
    "WITH v AS (SELECT CAST(label AS BIGINT) AS episode, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame, embedding AS e FROM embeddings) "
    + " UNION ALL ".join(f"SELECT episode, frame, '{g}' AS \"group\", {len(own)} AS width, round(list_sum(list_transform(e[{own.start + 1}:{own.stop}], lambda z: z::DOUBLE)), 6) AS total FROM v" for g, own in LAYOUT.items())
)
def grouped_features(spark, d):
    m = grouped_matrix(joints(spark, d), E, "q", NAMES, GROUPS)
    return rounded(m.select("episode", "frame", "group", F.size("x").alias("width"), F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("total")), "total")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{g}', {j}, {ch})" for g, j, ch in grouped_positions(NAMES, GROUPS)) + ") v(\"group\", pos, channel)")
def channel_layout(spark, d):
    return spark.createDataFrame(grouped_positions(NAMES, GROUPS), "`group` string, pos int, channel int")


# ---- phases ----------------------------------------------------------------------------------

_P = PHASE
PH = f"""{EV},
  ah AS (SELECT *, count(*) OVER g = {_P.grip_dwell} AND max(x) OVER g < {_P.closed} AS c, count(*) OVER g = {_P.grip_dwell} AND min(x) OVER g > {_P.opened} AS o, min(speed) OVER s > {_P.moving} AS mv
         FROM ev WINDOW g AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN CURRENT ROW AND {_P.grip_dwell - 1} FOLLOWING), s AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN CURRENT ROW AND {_P.speed_dwell - 1} FOLLOWING)),
  tg AS (SELECT episode, min(CASE WHEN c THEN frame END) AS t_grasp FROM ah GROUP BY 1),
  an AS (SELECT episode, t_grasp, min(CASE WHEN o AND frame > t_grasp THEN frame END) AS t_place FROM ah JOIN tg USING (episode) GROUP BY 1, 2)"""
RUNS = f"""{EV}, rp AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY frame) AS rn FROM ev), rg AS (SELECT *, rn - row_number() OVER (PARTITION BY episode ORDER BY frame) AS g FROM rp WHERE speed < {_P.still})"""


@query(f"WITH {PH} SELECT episode, t_grasp, t_place FROM an")
def gripper_anchors(spark, d):
    return B.gripper_anchors(trajectories(spark, d), E, "frame", PHASE, "x")


@query(f"WITH {RUNS} SELECT episode, min(frame) AS run_start, count(*) AS run_length FROM rg GROUP BY episode, g")
def stationary_runs(spark, d):
    return B.runs_of(trajectories(spark, d), E, "frame", F.col("speed") < PHASE.still)


@query(
    f"""WITH {EV}, n AS (SELECT episode, count(*) AS n FROM ev GROUP BY 1),
  rp AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY frame) AS rn FROM ev), ra AS (SELECT *, rn - row_number() OVER (PARTITION BY episode ORDER BY frame) AS g FROM rp WHERE speed < {_P.still}),
  rb AS (SELECT *, rn - row_number() OVER (PARTITION BY episode ORDER BY frame) AS g FROM rp JOIN n USING (episode) WHERE speed < {_P.still} AND frame < n // 3),
  fg AS (SELECT episode, min(s) AS fallback_grasp FROM (SELECT episode, min(frame) AS s FROM rb GROUP BY episode, g HAVING count(*) >= {2 * _P.speed_dwell}) GROUP BY 1),
  fp AS (SELECT episode, max(s) AS fallback_place FROM (SELECT episode, min(frame) AS s FROM ra GROUP BY episode, g HAVING count(*) >= {2 * _P.speed_dwell}) JOIN fg USING (episode) WHERE s > fallback_grasp GROUP BY 1)
SELECT episode, fallback_grasp, fallback_place FROM n LEFT JOIN fg USING (episode) LEFT JOIN fp USING (episode)"""
)
def fallback_anchors(spark, d):
    return B.fallback_anchors(trajectories(spark, d), E, "frame", PHASE)


PHL = f"""{PH},
  pj AS (SELECT ah.*, t_grasp AS g, t_place AS p FROM ah JOIN an USING (episode)),
  pe AS (SELECT episode, coalesce(min(CASE WHEN mv AND frame >= g AND frame < p THEN frame END), any_value(p)) AS ge, min(CASE WHEN mv AND frame >= p THEN frame END) AS pe FROM pj GROUP BY 1),
  ins AS (SELECT episode, max(s) AS ins FROM (SELECT episode, min(frame) AS s FROM (SELECT *, rn - row_number() OVER (PARTITION BY episode ORDER BY frame) AS gg FROM
    (SELECT pj.*, row_number() OVER (PARTITION BY pj.episode ORDER BY frame) AS rn FROM pj JOIN pe USING (episode) WHERE frame >= ge AND frame < p) WHERE speed < {_P.still}) GROUP BY episode, gg HAVING count(*) >= {_P.speed_dwell}) GROUP BY 1),
  pl AS (SELECT pj.episode, frame, t, CASE WHEN g IS NULL THEN 'unknown' WHEN p IS NULL THEN CASE WHEN frame < g THEN 'approach' ELSE 'grasp' END WHEN frame < g THEN 'approach' WHEN frame < ge THEN 'grasp' WHEN frame < coalesce(ins, p) THEN 'move'
    WHEN frame < p THEN 'insertion' WHEN pe IS NULL OR frame < pe THEN 'place' ELSE 'move_to_ready' END AS phase FROM pj JOIN pe USING (episode) LEFT JOIN ins USING (episode)),
  pr AS (SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY episode ORDER BY frame) = phase THEN 0 ELSE 1 END AS nw FROM pl),
  pg AS (SELECT *, sum(nw) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS grp FROM pr),
  rl AS (SELECT episode, phase, min(frame) AS start_idx, max(frame) AS end_idx, min(t) AS start_time, max(t) AS end_time FROM pg GROUP BY episode, phase, grp)"""


def phased(spark, d):
    t = trajectories(spark, d)
    return B.phase_labels(t, B.gripper_anchors(t, E, "frame", PHASE, "x"), E, "frame", PHASE)


@query(f"WITH {PHL} SELECT episode, frame, phase FROM pl")
def phase_labels(spark, d):
    return phased(spark, d).select("episode", "frame", "phase")


@query(f"WITH {PHL} SELECT episode, phase, start_idx, end_idx, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM rl")
def phase_rle(spark, d):
    return rounded(B.run_lengths(phased(spark, d), E, "frame", "phase"), "start_time", "end_time")


@query(
    f"""WITH {PHL}, dim(phase_order, phase) AS (VALUES {", ".join(f"({k}, '{p}')" for k, p in enumerate(B.PHASES))})
SELECT phase_order, phase, count(s) AS n, round(avg(s), 4) AS mean_s, round(stddev_pop(s), 4) AS std_s, round(min(s), 4) AS min_s, round(max(s), 4) AS max_s FROM dim LEFT JOIN (SELECT phase, end_time - start_time AS s FROM rl) USING (phase) GROUP BY 1, 2"""
)
def phase_stats(spark, d):
    return rounded(B.phase_stats(B.run_lengths(phased(spark, d), E, "frame", "phase")), "mean_s", "std_s", "min_s", "max_s", digits=4)


# ---- rotations -------------------------------------------------------------------------------

QV = "qv AS (SELECT CAST(label AS BIGINT) AS episode, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y, embedding[6]::DOUBLE AS z, embedding[7]::DOUBLE AS w FROM embeddings)"
RV = f"""{QV}, qn AS (SELECT *, greatest(sqrt(x * x + y * y + z * z + w * w), 1e-12) AS n, CASE WHEN w < 0 THEN -1.0 ELSE 1.0 END AS s FROM qv),
  qu AS (SELECT episode, frame, x / n * s AS a, y / n * s AS b, z / n * s AS c, w / n * s AS d FROM qn), ql AS (SELECT *, sqrt(a * a + b * b + c * c) AS l FROM qu),
  rv AS (SELECT episode, frame, a * f AS rx, b * f AS ry, c * f AS rz FROM (SELECT *, CASE WHEN l < 1e-12 THEN 2.0 ELSE 2 * atan2(l, d) / l END AS f FROM ql))"""


def _rotvecs(spark, d):
    p = lambda k: F.element_at("ee_pose", k)
    return joints(spark, d).select("episode", "frame", "t", quat_to_rotvec(p(4), p(5), p(6), p(7)).alias("r"))


def _xyz(df: DataFrame, v: str = "r") -> DataFrame:
    out = df.select("episode", "frame", *[F.element_at(v, k + 1).alias(n) for k, n in enumerate(("rx", "ry", "rz"))])
    return rounded(out, "rx", "ry", "rz")


@query(f"WITH {RV} SELECT episode, frame, round(rx, 6) + 0.0 AS rx, round(ry, 6) + 0.0 AS ry, round(rz, 6) + 0.0 AS rz FROM rv")
def quat_rotvec(spark, d):
    return _xyz(_rotvecs(spark, d))


@query(
    f"""WITH {RV}, ul AS (SELECT episode, list_reduce(list({{'i': frame, 'x': rx, 'y': ry, 'z': rz}} ORDER BY frame), lambda acc, s: list_append(acc, CASE WHEN len(acc) > 0 AND sqrt((s.x - acc[-1].x) * (s.x - acc[-1].x) + (s.y - acc[-1].y) * (s.y - acc[-1].y) + (s.z - acc[-1].z) * (s.z - acc[-1].z)) > {math.pi!r}
  THEN {{'i': s.i, 'x': 0.0 - s.x, 'y': 0.0 - s.y, 'z': 0.0 - s.z}} ELSE s END), CAST([] AS STRUCT(i BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[])) AS u FROM rv GROUP BY 1), ue AS (SELECT episode, unnest(u) AS s FROM ul)
SELECT episode, s.i AS frame, round(s.x, 6) + 0.0 AS rx, round(s.y, 6) + 0.0 AS ry, round(s.z, 6) + 0.0 AS rz FROM ue"""
)
def unwrap_orientation(spark, d):
    return _xyz(unwrap_rotvecs(_rotvecs(spark, d), E, "frame", "r"))


RM = f"""{QV}, qn AS (SELECT episode, frame, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, greatest(sqrt(x * x + y * y + z * z + w * w), 1e-12) AS n FROM qv)),
  mm AS (SELECT episode, frame, 1 - 2 * (y * y + z * z) AS a, 2 * (x * y - z * w) AS b, 2 * (x * z + y * w) AS c, 2 * (x * y + z * w) AS d, 1 - 2 * (x * x + z * z) AS e, 2 * (y * z - x * w) AS f, 2 * (x * z - y * w) AS g, 2 * (y * z + x * w) AS h, 1 - 2 * (x * x + y * y) AS i FROM qn),
  mq AS (SELECT episode, frame, CASE WHEN a + e + i > 0 THEN [(h - f) / (2 * sqrt(1 + a + e + i)), (c - g) / (2 * sqrt(1 + a + e + i)), (d - b) / (2 * sqrt(1 + a + e + i)), sqrt(1 + a + e + i) / 2]
    WHEN a > e AND a > i THEN [sqrt(1 + a - e - i) / 2, (b + d) / (2 * sqrt(1 + a - e - i)), (c + g) / (2 * sqrt(1 + a - e - i)), (h - f) / (2 * sqrt(1 + a - e - i))]
    WHEN e > i THEN [(b + d) / (2 * sqrt(1 + e - a - i)), sqrt(1 + e - a - i) / 2, (f + h) / (2 * sqrt(1 + e - a - i)), (c - g) / (2 * sqrt(1 + e - a - i))]
    ELSE [(c + g) / (2 * sqrt(1 + i - a - e)), (f + h) / (2 * sqrt(1 + i - a - e)), sqrt(1 + i - a - e) / 2, (d - b) / (2 * sqrt(1 + i - a - e))] END AS q FROM mm)"""


@query(f"WITH {RM} SELECT episode, frame, round(q[1], 6) + 0.0 AS qx, round(q[2], 6) + 0.0 AS qy, round(q[3], 6) + 0.0 AS qz, round(q[4], 6) + 0.0 AS qw FROM mq")
def rot_to_quat(spark, d):
    p = [F.element_at("ee_pose", k) for k in (4, 5, 6, 7)]
    n = F.greatest(F.sqrt(sum((v * v for v in p[1:]), p[0] * p[0])), F.lit(1e-12))
    j = joints(spark, d).select("episode", "frame", *[(v / n).alias(c) for v, c in zip(p, "xyzw", strict=True)])
    x, y, z, w = (F.col(c) for c in "xyzw")
    m = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    q = j.select("episode", "frame", matrix_to_quat(m).alias("q"))
    return rounded(q.select("episode", "frame", *[F.element_at("q", k + 1).alias(c) for k, c in enumerate(("qx", "qy", "qz", "qw"))]), "qx", "qy", "qz", "qw")


def _cart_sql() -> str:
    cols = ["px", "py", "pz"]
    g1 = ", ".join(f"{_grad(c, '', '', '(1 / 30.0)')} AS d_{c}" for c in cols)
    g2 = ", ".join(f"{_grad(f'd_{c}', '', '', '(1 / 30.0)')} AS dd_{c}" for c in cols)
    every = [p + c for p in ("", "d_", "dd_") for c in cols]
    return f"""WITH cp AS (SELECT CAST(label AS BIGINT) AS episode, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS k, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS pz FROM embeddings),
  c1 AS (SELECT *, {g1} FROM cp WINDOW w AS (PARTITION BY episode ORDER BY k)), c2 AS (SELECT *, {g2} FROM c1 WINDOW w AS (PARTITION BY episode ORDER BY k)), {_scale_sql(every, "c2")}"""


@query(_cart_sql())
def cartesian_features(spark, d):
    cols = ["px", "py", "pz"]
    j = joints(spark, d).select("episode", F.col("frame").alias("k"), *[F.element_at("ee_pose", i + 1).alias(c) for i, c in enumerate(cols)])
    for c in cols:
        j = S.gradient(S.gradient(j, E, "k", c, f"d_{c}", 1 / 30.0), E, "k", f"d_{c}", f"dd_{c}", 1 / 30.0)
    every = [p + c for p in ("", "d_", "dd_") for c in cols]
    j = scale_columns(j, E, {c: "cartesian" for c in every}, PLAIN)
    return rounded(j.select("episode", "k", *every), *every, digits=5)
