"""Queries of whole-vector features, the penalised optimum and the whole run, with their SQL.

Stand-ins as in ``series_queries``: a label's ``embeddings`` are joint states, a user's ``events`` a recording.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrain.functions.changepoints import ChangeConfig
from kinegrain.functions.primitives import PrimitiveConfig
from kinegrain.operators import kernels as K
from kinegrain.operators import timeseries as S
from kinegrain.operators.features import FeatureConfig, feature_matrices
from kinegrain.plans.pipeline import mean_runtimes, method_rows, process_recordings
from kinegrain.plans.series_queries import GROUPS, NAMES, RV, _grad, joints, rounded, trajectories

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def cells(features: DataFrame) -> DataFrame:
    """episode, k, feature, value of feature vectors; names stand in the row of k 0."""
    names = features.where("names is not null").select("episode", F.col("names").alias("__n"))
    each = features.where("k is not null").select("episode", "k", "x").join(names, "episode")
    out = each.select("episode", "k", F.explode(F.arrays_zip("__n", "x")).alias("z")).select("episode", "k", F.col("z.__n").alias("feature"), F.col("z.x").alias("value"))
    return rounded(out, "value", digits=5)


def _scaled(src: str, where: str = "true") -> str:
    """SQL that scales ``value`` of rows (episode, k, feature, value) by median and MAD."""
    return f"""sm AS (SELECT *, median(value) OVER (PARTITION BY episode, feature) AS m FROM {src} WHERE {where}), sd AS (SELECT *, 1.4826 * median(abs(value - m)) OVER (PARTITION BY episode, feature) AS d FROM sm)
SELECT episode, k, feature, round((value - m) / CASE WHEN abs(d) < 1e-8 THEN 1 ELSE d END, 5) + 0.0 AS value FROM sd"""


DT = "(1 / 30.0::DOUBLE)"
VEC = "v AS (SELECT CAST(label AS BIGINT) AS episode, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS k, embedding AS e FROM embeddings)"
GRADS = f"""g1 AS (SELECT *, {_grad("q", "", "", DT)} AS dq FROM qs WINDOW w AS (PARTITION BY episode, ch ORDER BY k)),
  g2 AS (SELECT *, {_grad("dq", "", "", DT)} AS ddq FROM g1 WINDOW w AS (PARTITION BY episode, ch ORDER BY k))"""
PLAIN = FeatureConfig(smoothing="none")


def _smoothed_sql(window: int = 11, order: int = 3, channels: int = 4) -> str:
    rows = ", ".join(f"({p}, {k}, {float(w)!r}::DOUBLE)" for p, r in enumerate(S.savgol_matrix(window, order)) for k, w in enumerate(r))
    h = window // 2
    return f"""WITH {VEC}, w(p, j, w) AS (VALUES {rows}), c AS (SELECT unnest(range({channels})) AS ch), raw AS (SELECT episode, k, ch, e[ch + 1]::DOUBLE AS x, count(*) OVER (PARTITION BY episode, ch) AS n FROM v CROSS JOIN c),
  b AS (SELECT *, CASE WHEN k < {h} THEN k WHEN k >= n - {h} THEN {window} - (n - k) ELSE {h} END AS p, greatest(0, least(n - {window}, k - {h})) AS s FROM raw),
  qs AS (SELECT b.episode, b.ch, b.k, sum(w.w * r.x) AS q FROM b JOIN w USING (p) JOIN raw r ON r.episode = b.episode AND r.ch = b.ch AND r.k = b.s + w.j GROUP BY 1, 2, 3), {GRADS},
  long AS (SELECT episode, k, 'q_' || ch AS feature, q AS value FROM g2 UNION ALL SELECT episode, k, 'dq_' || ch, dq FROM g2 UNION ALL SELECT episode, k, 'ddq_' || ch, ddq FROM g2), {_scaled("long")}"""


@query(_smoothed_sql())
def smoothed_joint_features(spark, d):
    """The joint block, smoothed by local cubics before it is differentiated."""
    j = joints(spark, d).withColumn("q", F.slice("q", 1, 4))
    return cells(feature_matrices(j, "episode", "frame", "joint", FeatureConfig()))


def _rotation_sql() -> str:
    near = f"sqrt((s.x - acc[-1].x) * (s.x - acc[-1].x) + (s.y - acc[-1].y) * (s.y - acc[-1].y) + (s.z - acc[-1].z) * (s.z - acc[-1].z)) > {math.pi!r}"
    return f"""WITH {RV}, {VEC}, ul AS (SELECT episode, list_reduce(list({{'i': frame, 'x': rx, 'y': ry, 'z': rz}} ORDER BY frame), lambda acc, s: list_append(acc, CASE WHEN len(acc) > 0 AND {near} THEN {{'i': s.i, 'x': 0.0 - s.x, 'y': 0.0 - s.y, 'z': 0.0 - s.z}} ELSE s END),
    CAST([] AS STRUCT(i BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[])) AS u FROM rv GROUP BY 1), ue AS (SELECT episode, unnest(u) AS s FROM ul), c AS (SELECT unnest(range(3)) AS ch),
  qs AS (SELECT episode, k, 'pos' AS kind, 'pos_' || ch AS ch, e[ch + 1]::DOUBLE AS q FROM v CROSS JOIN c UNION ALL SELECT episode, s.i, 'rot', 'rot_' || ch, CASE ch WHEN 0 THEN s.x WHEN 1 THEN s.y ELSE s.z END FROM ue CROSS JOIN c), {GRADS},
  long AS (SELECT episode, k, CASE kind WHEN 'pos' THEN ch ELSE replace(ch, 'rot', 'rotvec') END AS feature, q AS value FROM g2 UNION ALL SELECT episode, k, 'd' || ch, dq FROM g2 UNION ALL SELECT episode, k, 'dd' || ch, ddq FROM g2), {_scaled("long")}"""


@query(_rotation_sql())
def cartesian_rotation_features(spark, d):
    """Position and rotation blocks of a pose, its rotation vectors unwrapped."""
    return cells(feature_matrices(joints(spark, d), "episode", "frame", "cartesian", PLAIN))


def _grouped_sql() -> str:
    place = ", ".join(f"({ch}, '{g}', {j})" for g, own in GROUPS.items() for j, n in enumerate(own) if n in NAMES for ch in [NAMES.index(n)])
    name = lambda prefix: f"'{prefix}_' || g || '_' || j"
    return f"""WITH {VEC}, c(ch, g, j) AS (VALUES {place}), qs AS (SELECT episode, k, ch, g, j, e[ch + 1]::DOUBLE AS q, e[ch + 21]::DOUBLE AS cmd FROM v CROSS JOIN c), {GRADS},
  long AS (SELECT episode, k, {name("q")} AS feature, q AS value FROM g2 UNION ALL SELECT episode, k, {name("dq")}, dq FROM g2 UNION ALL SELECT episode, k, {name("ddq")}, ddq FROM g2 UNION ALL SELECT episode, k, {name("q_cmd")}, cmd FROM g2 UNION ALL SELECT episode, k, {name("q_err")}, cmd - q FROM g2),
  {_scaled("long")}"""


@query(_grouped_sql())
def grouped_command_features(spark, d):
    """State, derivatives, command and error of every group of joints."""
    return cells(feature_matrices(joints(spark, d), "episode", "frame", "joint_command", FeatureConfig(smoothing="none", joint_groups=GROUPS), NAMES))


# ---- the penalised optimum -----------------------------------------------------------------------

PENALTY = 50_000.0
EVX = "ev AS (SELECT user_id AS episode, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame, value AS x FROM events)"
_LEAST = 5
PELT = f"""{EVX}, su AS (SELECT episode, frame, sum(x) OVER w AS a, sum(x * x) OVER w AS b FROM ev WINDOW w AS (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING)),
  ps AS (SELECT episode, count(*) AS n, list_prepend(0.0::DOUBLE, list(a ORDER BY frame)) AS a, list_prepend(0.0::DOUBLE, list(b ORDER BY frame)) AS b FROM su GROUP BY 1),
  op AS (SELECT episode, n, list_reduce(range(1, n + 1), lambda acc, e: list_append(acc, CASE WHEN e < {_LEAST} THEN {{'c': 'infinity'::DOUBLE, 's': CAST(-1 AS BIGINT)}} ELSE list_min(list_transform(list_filter(range(0, e - {_LEAST} + 1), lambda s: s = 0 OR s >= {_LEAST}),
    lambda s: {{'c': acc[s + 1].c + (b[e + 1] - b[s + 1]) - (a[e + 1] - a[s + 1]) * (a[e + 1] - a[s + 1]) / (e - s) + {PENALTY!r}::DOUBLE, 's': s}})) END), [{{'c': {-PENALTY!r}::DOUBLE, 's': CAST(-1 AS BIGINT)}}]) AS t FROM ps),
  bk AS (SELECT episode, n, list_reduce(range(n), lambda acc, i: CASE WHEN acc[1] > 0 THEN list_prepend(t[acc[1] + 1].s, acc) ELSE acc END, [n]) AS cuts FROM op)"""


@query(f"WITH {PELT} SELECT episode, array_to_string(list_filter(cuts, lambda z: z > 0 AND z < n), ';') AS boundary_frames FROM bk")
def pelt_optimum(spark, d):
    """Boundaries of the least squared error plus a penalty each; the SQL tries every segmentation by dynamic programming."""
    v = trajectories(spark, d).select("episode", "frame", F.array("x").alias("v"))
    found = K.change_points(v, "episode", "frame", "v", ChangeConfig(model="l2", penalty=PENALTY), ("pelt",))
    return found.select("episode", F.array_join(F.transform("boundaries", lambda b: b.cast("string")), ";").alias("boundary_frames"))


# ---- the whole run -------------------------------------------------------------------------------


def _results(spark, d) -> DataFrame:
    j = joints(spark, d).withColumn("q", F.slice("q", 1, 2))
    return process_recordings(j, "episode", "frame", "joint", FeatureConfig(), ChangeConfig(model="l2"), PrimitiveConfig(window=5), ("clasp", "bocpd"))


@query()
def episode_results(spark, d):
    """Features, searches with the penalty of the elbow, segmenters and primitives with the number of clusters of the best silhouette."""
    r = _results(spark, d)
    return r.select("episode", "modality", "status", "reason", "n_frames", F.size("feature_names").alias("n_features"), F.transform("methods", lambda m: F.struct(m.method.alias("method"), m.boundaries.alias("boundaries"))).alias("methods"), "primitives.k", "primitives.labels", "primitives.silhouette")


@query()
def method_runtimes(spark, d):
    return mean_runtimes(method_rows(_results(spark, d), "episode"))
