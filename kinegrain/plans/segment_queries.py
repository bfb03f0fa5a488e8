"""Queries of labelling, evaluation, clustering, sampling, kernels and text, with SQL where it can say the same."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinegrain.functions.changepoints import ChangeConfig
from kinegrain.functions.primitives import PrimitiveConfig
from kinegrain.operators import evaluation as V
from kinegrain.operators import kernels as K
from kinegrain.operators import labeling as L
from kinegrain.operators import report as R
from kinegrain.operators.clusters import cluster_sizes, mean_pool, representatives, silhouettes, transitions
from kinegrain.operators.sampling import linspace_sample, systematic_sample
from kinegrain.operators.trajectory import detect_boundaries, segment_trajectories
from kinegrain.plans.pipeline import pipeline_boundaries, pipeline_summary as summarise
from kinegrain.plans.series_queries import E, EV, MERGED, SEGS, joints, merged, rounded, rules, segments, trajectories
from kinegrain.sources.tables import table
from kinegrain.sources.texts import BLANK, segment_texts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- labelled segments -----------------------------------------------------------------------


def _posed(spark, d) -> DataFrame:
    t = trajectories(spark, d)
    return t.select("episode", "frame", "t", (0.3 + F.col("x") / 1000).alias("x"), (0.15 - F.col("x") / 2000).alias("y"), (F.col("x") / 3000).alias("z"), (F.col("x") / 2000).alias("speed"), "gripper", (1 - F.col("x") / 1000).alias("alignment"))


POSED = f"{SEGS}, po AS (SELECT episode, frame, t, 0.3 + x / 1000 AS x, 0.15 - x / 2000 AS y, x / 3000 AS z, x / 2000 AS speed, gripper, 1 - x / 1000 AS alignment FROM ev)"


def _facts_sql() -> str:
    p = L.task_profile("charger_insertion")
    xy = lambda c: f"sqrt((x - ({c[0]})) * (x - ({c[0]})) + (y - ({c[1]})) * (y - ({c[1]})))"
    share = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    pick, ins = p.pick_zone_center, p.insertion_zone_center
    return f"""{POSED}, jf AS (SELECT sg.*, po.* EXCLUDE (episode), CASE WHEN lag(gripper >= 0.5) OVER (PARTITION BY sg.episode, seg_id ORDER BY t) <> (gripper >= 0.5) THEN 1 ELSE 0 END AS turn FROM sg JOIN po ON sg.episode = po.episode AND po.t >= start_t AND po.t <= end_t),
  fa AS (SELECT episode, seg_id, start_t, end_t, {share("gripper < 0.5")} > 0.6 AS g_open, {share("gripper >= 0.5")} > 0.6 AS g_closed, sum(turn) AS tr,
    {share(f"{xy(pick)} <= {p.pick_zone_radius_xy}")} > 0.5 AS np, {share(f"abs(z - {pick[2]}) <= {p.pick_zone_z_tol}")} > 0.5 AS npz, {share(f"{xy(ins)} <= {p.insertion_zone_radius_xy}")} > 0.5 AS ni, {share(f"abs(z - {ins[2]}) <= {p.insertion_z_tol}")} > 0.5 AS niz,
    {share(f"{xy(p.ready_pose)} <= {p.ready_pose_tol}")} > 0.5 AS nr, avg(speed) > {p.move_speed_threshold} AS mv, avg(speed) <= {p.precision_speed_threshold} AS pr, avg(alignment) >= 1 - {p.alignment_tolerance} AS al FROM jf GROUP BY 1, 2, 3, 4),
  rn AS (SELECT *, tr > 0 AND g_open AS rel, max(CASE WHEN tr > 0 AND g_open THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY seg_id ROWS UNBOUNDED PRECEDING) = 1 AS rs FROM fa),
  sc AS (SELECT *, 35 * np::INT + 20 * npz::INT + 35 * g_open::INT AS s0, 45 * (tr > 0)::INT + 30 * g_closed::INT + 20 * np::INT AS s1, 35 * g_closed::INT + 40 * mv::INT + 15 * (NOT ni)::INT AS s2, 35 * ni::INT + 20 * niz::INT + 25 * al::INT + 15 * pr::INT AS s3,
    45 * rel::INT + 25 * ni::INT + 20 * (NOT mv)::INT AS s4, 30 * (rs OR rel)::INT + 40 * nr::INT + 20 * (mv OR nr)::INT AS s5 FROM rn),
  lb AS (SELECT *, greatest(s0, s1, s2, s3, s4, s5) AS top FROM sc),
  ls AS (SELECT episode, seg_id, start_t, end_t, CASE top WHEN s0 THEN 'approach' WHEN s1 THEN 'grasp' WHEN s2 THEN 'move' WHEN s3 THEN 'insertion' WHEN s4 THEN 'place' ELSE 'move_to_ready' END AS label, least(1.0, top / 100 + least(0.15, 0.05 * tr)) AS confidence FROM lb)"""


LABELLED = _facts_sql()


def labelled(spark, d) -> DataFrame:
    _, seg = segments(spark, d)
    return L.label_segments(L.segment_facts(_posed(spark, d), seg, E, L.task_profile("charger_insertion")), E)


@query(f"WITH {LABELLED} SELECT episode, seg_id, label, round(confidence, 6) AS confidence FROM ls")
def segment_labels(spark, d):
    return rounded(labelled(spark, d).select("episode", "seg_id", "label", "confidence"), "confidence")


_EVIDENCE = (
    ("np", "near pick-zone (xy)"), ("npz", "pick-zone z alignment"), ("g_open", "gripper mostly open"), ("tr > 0", "gripper transition detected"), ("g_closed", "gripper mostly closed"), ("np", "grasp near pick-zone"),
    ("g_closed", "closed gripper while moving"), ("mv", "ee speed above move threshold"), ("NOT ni", "not yet in insertion zone"), ("ni", "near insertion zone (xy)"), ("niz", "insertion z alignment"), ("al", "pose alignment high"),
    ("pr", "low-speed precision motion"), ("rel", "gripper release event"), ("ni", "place at goal zone"), ("NOT mv", "settled after release"), ("rs OR rel", "after release phase"), ("nr", "near ready pose"), ("mv OR nr", "return-to-ready trajectory"),
)
_SAID = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _EVIDENCE) + "], lambda x: x IS NOT NULL)), '; ')"


@query(f"WITH {LABELLED} SELECT episode, seg_id, round(start_t, 6) AS start_t, round(end_t, 6) AS end_t, {_SAID} AS evidence FROM lb")
def segment_evidence(spark, d):
    return rounded(labelled(spark, d).select("episode", "seg_id", "start_t", "end_t", F.array_join("evidence", "; ").alias("evidence")), "start_t", "end_t")


@query(f"WITH {LABELLED} SELECT episode, seg_id, label, round(confidence, 6) AS confidence FROM ls WHERE round(confidence, 6) < 0.95")
def low_confidence(spark, d):
    x = rounded(labelled(spark, d).select("episode", "seg_id", "label", "confidence"), "confidence")
    return R.low_confidence(x, 0.95)


@query(f"WITH {LABELLED} SELECT episode, CAST(row_number() OVER (PARTITION BY episode ORDER BY start_t, end_t, label) - 1 AS INTEGER) AS segment_id, label, round(end_t - start_t, 6) AS duration FROM ls")
def timeline(spark, d):
    return rounded(R.timeline(R.rename_for_report(labelled(spark, d)), E).select("episode", "segment_id", "label", "duration"), "duration")


@query(f"WITH {LABELLED} SELECT episode, label, count(*) AS n, round(sum(end_t - start_t), 4) AS total_s, round(avg(end_t - start_t), 4) AS mean_s, round(min(end_t - start_t), 4) AS min_s, round(max(end_t - start_t), 4) AS max_s FROM ls GROUP BY 1, 2")
def episode_label_stats(spark, d):
    return rounded(R.label_duration_stats(R.rename_for_report(labelled(spark, d)), E), "total_s", "mean_s", "min_s", "max_s", digits=4)


@query("SELECT label, count(*) AS n, round(sum(greatest(0, end_t - start_t)), 4) AS total_s, round(avg(greatest(0, end_t - start_t)), 6) AS mean_s, round(min(greatest(0, end_t - start_t)), 6) AS min_s, round(max(greatest(0, end_t - start_t)), 6) AS max_s FROM (SELECT DISTINCT segment_id, label, start_t, end_t FROM segments) GROUP BY 1")
def label_duration_stats(spark, d):
    s = table(spark, d, "segments").select("segment_id", "label", F.col("start_t").alias("start"), F.col("end_t").alias("end")).distinct()
    return rounded(rounded(R.label_duration_stats(s), "mean_s", "min_s", "max_s"), "total_s", digits=4)


@query(
    f"""WITH {LABELLED}, tl AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode ORDER BY start_t, end_t, label) - 1 AS INTEGER) AS segment_id FROM ls),
  hit AS (SELECT ev.episode, frame, max(segment_id) AS segment_id FROM ev JOIN tl ON tl.episode = ev.episode AND ev.t >= start_t AND ev.t <= end_t GROUP BY 1, 2) SELECT episode, frame, coalesce(segment_id, -1) AS segment_id FROM ev LEFT JOIN hit USING (episode, frame)"""
)
def frame_segment_index(spark, d):
    seg = R.timeline(R.rename_for_report(labelled(spark, d)), E)
    return R.frame_segments(trajectories(spark, d), seg, E, "frame")


@query(
    f"""WITH {LABELLED}, tl AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode ORDER BY start_t, end_t, label) - 1 AS INTEGER) AS segment_id FROM ls)
SELECT section, count(*) AS n FROM (SELECT 'timeline' AS section FROM tl UNION ALL SELECT 'label_duration_stats' FROM (SELECT DISTINCT episode, label FROM ls) UNION ALL SELECT 'low_confidence' FROM tl WHERE confidence < 0.5) GROUP BY 1"""
)
def summary_sections(spark, d):
    return R.summary_sections(R.rename_for_report(labelled(spark, d)), E).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


SCALED = {"min_segment_duration_s": 20000.0, "hysteresis_duration_s": 20000.0, "stop_speed_threshold": 0.015, "speed_change_threshold": 0.075}


@query()
def hybrid_boundaries(spark, d):
    """Rules and change-points of posed trajectories together."""
    return R.boundary_strings(detect_boundaries(_posed(spark, d), "episode", "frame", L.task_profile("charger_insertion", **SCALED)), [*E, "error"])


@query()
def hybrid_segments(spark, d):
    return segment_trajectories(_posed(spark, d), "episode", "frame", L.task_profile("charger_insertion", **SCALED))


# ---- evaluation ------------------------------------------------------------------------------

# reference boundaries: changes of the event type into 'error' or 'purchase'
REF = "rf AS (SELECT episode, list(frame ORDER BY frame) FILTER (WHERE frame > 0 AND event_type IN ('error', 'purchase')) AS ref FROM ev GROUP BY 1), pa AS (SELECT mb.episode, boundaries AS pred, coalesce(ref, CAST([] AS BIGINT[])) AS ref, b + 1 AS n FROM mb JOIN rf USING (episode))"


def _pairs(spark, d) -> DataFrame:
    t, m = merged(spark, d)
    ref = t.groupBy("episode").agg(F.array_sort(F.collect_list(F.when((F.col("frame") > 0) & F.col("event_type").isin("error", "purchase"), F.col("frame")))).alias("ref"), F.count(F.lit(1)).alias("n"))
    return m.withColumnRenamed("boundaries", "pred").join(ref, "episode")


def _match_sql(tol: float) -> str:
    # the candidates left are ordered by distance, then by size
    return f"list_reduce(pred, lambda acc, p: CASE WHEN len(list_filter(acc.rest, lambda r: abs(r - p) <= {tol})) > 0 THEN {{'tp': acc.tp + 1, 'rest': list_filter(acc.rest, lambda r: r <> list_sort(list_transform(list_filter(acc.rest, lambda q: abs(q - p) <= {tol}), lambda q: {{'d': abs(q - p), 'r': q}}))[1].r)}} ELSE acc END, {{'tp': 0, 'rest': ref}}).tp"


@query(
    f"""WITH {MERGED}, {REF}, mt AS (SELECT *, {_match_sql(1)} AS tp, len(pred) AS a, len(ref) AS b FROM pa), pr AS (SELECT *, tp / a AS p, tp / b AS r FROM mt)
SELECT episode, round(CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 OR b = 0 THEN 0 ELSE p END, 6) AS "precision", round(CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 OR b = 0 THEN 0 ELSE r END, 6) AS recall,
  round(CASE WHEN a = 0 OR b = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pr"""
)
def boundary_agreement(spark, d):
    x = V.boundary_agreement(_pairs(spark, d), "pred", "ref", 1)
    return rounded(x.select("episode", "precision", "recall", "f1"), "precision", "recall", "f1")


@query(
    f"""WITH {MERGED}, {REF}, ps AS (SELECT episode, list_transform(pred, lambda v: v / 10) AS pred, list_transform(ref, lambda v: v / 10) AS ref FROM pa), mt AS (SELECT *, {_match_sql(0.25)} AS tp, len(pred) AS a, len(ref) AS b FROM ps),
  pr AS (SELECT *, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE tp / a END AS p, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE tp / b END AS r FROM mt) SELECT episode, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pr"""
)
def boundary_f1(spark, d):
    s = lambda c: F.transform(c, lambda v: v / 10.0)
    x = V.boundary_f1_seconds(_pairs(spark, d).withColumns({"pred": s("pred"), "ref": s("ref")}), "pred", "ref", 0.25)
    return rounded(x.select("episode", "precision", "recall", "f1"), "precision", "recall", "f1")


@query(
    f"""WITH {MERGED}, ed AS (SELECT episode, unnest(list_concat([0], boundaries, [b + 1])) AS e FROM mb), dl AS (SELECT episode, (lead(e) OVER (PARTITION BY episode ORDER BY e) - e) / 10 AS s FROM ed)
SELECT episode, count(s) AS n_segments, round(avg(s), 6) AS mean_s, round(stddev_pop(s), 6) AS std_s, round(min(s), 6) AS min_s, round(max(s), 6) AS max_s, round(sum(s), 6) AS total_s FROM dl GROUP BY 1"""
)
def duration_stats(spark, d):
    t, m = merged(spark, d)
    n = t.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    return rounded(V.duration_stats(m.join(n, "episode"), E, "boundaries", "n", 10.0), "mean_s", "std_s", "min_s", "max_s", "total_s")


def _methods(spark, d) -> DataFrame:
    """Three methods per recording: the merged rules, the reference, and every eighth frame."""
    p = _pairs(spark, d)
    grid = F.filter(F.sequence(F.lit(8).cast("bigint"), F.greatest(F.lit(8), F.col("n")).cast("bigint"), F.lit(8).cast("bigint")), lambda v: v < F.col("n"))
    each = F.array(*[F.struct(F.lit(k).alias("method_ord"), F.lit(m).alias("method"), b.cast("array<bigint>").alias("boundaries")) for k, (m, b) in enumerate((("rules", F.col("pred")), ("events", F.col("ref")), ("grid", grid)))])
    return p.select("episode", F.explode(each).alias("m")).select("episode", "m.*")


PAIRS = f"""{MERGED}, {REF}, me AS (SELECT episode, 0 AS o, 'rules' AS m, pred AS bs FROM pa UNION ALL SELECT episode, 1, 'events', ref FROM pa UNION ALL SELECT episode, 2, 'grid', list_filter(range(8, greatest(9, n), 8), lambda v: v < n) FROM pa),
  pp AS (SELECT x.episode, x.m || '_vs_' || y.m AS pair, x.bs AS ref, y.bs AS pred FROM me x JOIN me y ON x.episode = y.episode AND x.o < y.o), mt AS (SELECT *, {_match_sql(2)} AS tp, len(pred) AS a, len(ref) AS b FROM pp), pr AS (SELECT *, tp / a AS p, tp / b AS r FROM mt),
  pc AS (SELECT episode, pair, CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 OR b = 0 THEN 0 ELSE p END AS "precision", CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 OR b = 0 THEN 0 ELSE r END AS recall, CASE WHEN a = 0 OR b = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""


@query(f'WITH {PAIRS} SELECT episode, pair, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc')
def pairwise_comparison(spark, d):
    return rounded(V.compare_methods(_methods(spark, d), E, 2), "precision", "recall", "f1")


@query(f'WITH {PAIRS} SELECT pair, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS n_episodes FROM pc GROUP BY 1')
def aggregate_comparison(spark, d):
    return rounded(V.mean_ignoring_missing(V.compare_methods(_methods(spark, d), E, 2), ["pair"], ["precision", "recall", "f1"]), "precision", "recall", "f1")


@query(f"WITH {MERGED} SELECT episode, CASE WHEN len(boundaries) = 0 THEN 'N/A' ELSE printf('%.3f', round((b + 1) / len(boundaries), 3)) END AS frames_per_boundary, CAST(len(boundaries) AS VARCHAR) AS n FROM mb")
def formatted_stats(spark, d):
    t, m = merged(spark, d)
    n = t.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    k = F.size("boundaries")
    x = m.join(n, "episode").select("episode", F.when(k > 0, F.col("n") / k).alias("v"), k.alias("k"))
    return x.select("episode", V.fmt_float(F.col("v")).alias("frames_per_boundary"), V.fmt_int(F.col("k")).alias("n"))


@query(f"WITH {SEGS} SELECT episode, CAST(count(*) AS INTEGER) AS n_matched, round(avg((end_t - (start_t + 0.1 * (end_t - start_t))) / (end_t - start_t)), 6) AS mean_iou FROM sg GROUP BY 1")
def segment_iou(spark, d):
    """Rule segments against the same ones shifted by a tenth of their length."""
    s = R.rename_for_report(labelled(spark, d)).select("episode", "label", "start", "end")
    truth = s.withColumn("start", F.col("start") + 0.1 * (F.col("end") - F.col("start")))
    return rounded(V.segment_iou(s, truth, E), "mean_iou")


# ---- clusters --------------------------------------------------------------------------------

LABEL = "dense_rank() OVER (ORDER BY event_type) - 1"


def _labels(spark, d) -> DataFrame:
    kinds = ("click", "error", "purchase", "signup", "view")
    number = F.coalesce(*[F.when(F.col("event_type") == k, i) for i, k in enumerate(kinds)])
    return trajectories(spark, d).withColumn("label", number)


LABELS_SQL = f"{EV}, la AS (SELECT *, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS label FROM ev)"


@query(f"WITH {LABELS_SQL}, n AS (SELECT label AS a, lead(label) OVER (PARTITION BY episode ORDER BY frame) AS b FROM la), c AS (SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY 1, 2), k AS (SELECT unnest(range(5)) AS k) SELECT CAST(x.k AS INTEGER) AS a, CAST(y.k AS INTEGER) AS b, coalesce(n, 0) AS n FROM k x CROSS JOIN k y LEFT JOIN c ON c.a = x.k AND c.b = y.k")
def transition_matrix(spark, d):
    return transitions(_labels(spark, d), E, "frame", "label", 5)


@query(f"WITH {LABELS_SQL}, k AS (SELECT unnest(range(6)) AS k) SELECT CAST(k AS INTEGER) AS label, count(label) AS n FROM k LEFT JOIN la ON label = k GROUP BY 1")
def cluster_sizes_query(spark, d):
    return cluster_sizes(_labels(spark, d), "label", 6)


POOL = "po AS (SELECT CAST(label AS BIGINT) AS label, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings)"


@query(f"WITH {POOL}, e AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM po) SELECT label, pos, round(avg(x), 6) AS mean FROM e GROUP BY 1, 2")
def mean_pool_query(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return rounded(mean_pool(e, ["label"], "v").select("label", F.posexplode("pooled").alias("pos", "mean")).withColumn("pos", (F.col("pos") + 1).cast("bigint")), "mean")


@query(
    f"""WITH {POOL}, e AS (SELECT label, vec_id, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM po), c AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY 1, 2),
  dd AS (SELECT label, vec_id, sqrt(sum((x - m) * (x - m))) AS dist FROM e JOIN c USING (label, pos) GROUP BY 1, 2) SELECT label, arg_min(vec_id, dist) AS representative, round(min(dist), 6) AS distance FROM dd GROUP BY 1"""
)
def representatives_query(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("label"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(representatives(e, "label", "vec_id", "v"), "distance")


@query(
    f"""WITH {EV}, se AS (SELECT episode, event_type AS label, avg(x) AS m FROM ev WHERE episode IN (SELECT episode FROM ev GROUP BY 1) GROUP BY 1, 2),
  cl AS (SELECT episode, label, m, CASE WHEN m < avg(m) OVER (PARTITION BY episode) THEN 0 ELSE 1 END AS c FROM se), pw AS (SELECT a.episode, a.label, a.c, b.c AS oc, sum(abs(a.m - b.m)) AS s, count(*) AS n FROM cl a JOIN cl b ON a.episode = b.episode GROUP BY 1, 2, 3, 4),
  sl AS (SELECT episode, label, max(CASE WHEN c = oc THEN n END) AS own, max(CASE WHEN c = oc THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN c <> oc THEN s / n END) AS b FROM pw GROUP BY 1, 2)
SELECT episode, round(avg(CASE WHEN own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sl WHERE b IS NOT NULL GROUP BY 1"""
)
def silhouette(spark, d):
    s = trajectories(spark, d).groupBy("episode", F.col("event_type").alias("item")).agg(F.avg("x").alias("m"))
    c = s.withColumn("cluster", F.when(F.col("m") < F.avg("m").over(Window.partitionBy("episode")), 0).otherwise(1)).withColumn("v", F.array("m"))
    return rounded(silhouettes(c, E, "item", "cluster", "v"), "silhouette")


# ---- index and samples -----------------------------------------------------------------------


@query("SELECT DISTINCT episode_index AS episode_id FROM frames WHERE episode_index IS NOT NULL")
def distinct_episodes(spark, d):
    from kinegrain.sources.datasets import distinct_episodes as op

    return op(table(spark, d, "frames"), "episode_index")


@query(
    r"""WITH f AS (SELECT DISTINCT TRY_CAST(nullif(regexp_extract(file_path, 'episode_0*([0-9]+)[^/]*\.parquet$', 1), '') AS BIGINT) AS episode_index FROM frame_files), i AS (SELECT episode_index FROM f WHERE episode_index IS NOT NULL UNION SELECT episode_index FROM frames WHERE episode_index IS NOT NULL),
  m AS (SELECT episode_index, min(length) AS length, min(CASE WHEN fps > 0 THEN fps END) AS fps FROM episodes GROUP BY 1) SELECT episode_index, length, coalesce(fps, 30) AS fps FROM i LEFT JOIN m USING (episode_index)"""
)
def episode_index(spark, d):
    """Episodes of file names and of frames with their metadata."""
    from kinegrain.sources.tables import clean_episodes, episode_of_path

    files = table(spark, d, "frame_files").select(episode_of_path(F.col("file_path")).alias("episode_index")).where("episode_index is not null")
    ids = files.union(table(spark, d, "frames").select("episode_index").where("episode_index is not null")).distinct()
    e = table(spark, d, "episodes")
    meta = clean_episodes(e).select("episode_index", "fps").join(e.groupBy("episode_index").agg(F.min("length").alias("length")), "episode_index")
    return ids.join(meta, "episode_index", "left").select("episode_index", "length", F.coalesce("fps", F.lit(30.0)).alias("fps"))


N_SAMPLE = 23
_DRAW = random.Random(42).random()
RANKED = "r AS (SELECT episode, row_number() OVER (ORDER BY episode) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id AS episode FROM events))"


def _ids(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("episode")).distinct()


@query(f"WITH {RANKED}, k AS (SELECT unnest(range({N_SAMPLE})) AS k) SELECT DISTINCT episode FROM r JOIN k ON i = CAST(floor({_DRAW!r} * (n / {N_SAMPLE}) + k * (n / {N_SAMPLE})) AS BIGINT)")
def systematic(spark, d):
    return systematic_sample(_ids(spark, d), ["episode"], N_SAMPLE, 42)


@query(f"WITH {RANKED}, k AS (SELECT unnest(range({N_SAMPLE})) AS k) SELECT DISTINCT episode FROM r JOIN k ON i = CASE WHEN k = {N_SAMPLE - 1} THEN n - 1 ELSE CAST(floor(k * ((n - 1) / {N_SAMPLE - 1})) AS BIGINT) END")
def linspace(spark, d):
    return linspace_sample(_ids(spark, d), ["episode"], N_SAMPLE)


# ---- kernels: no SQL -------------------------------------------------------------------------


def _signal(spark, d) -> DataFrame:
    return trajectories(spark, d).select("episode", "frame", F.array("x").alias("v"))


def _kernel(model: str):
    def run(spark, d):
        return K.change_points(_signal(spark, d), "episode", "frame", "v", ChangeConfig(model=model), ("pelt", "binseg", "window", "bottomup")).drop("runtime_s")

    run.__name__ = f"change_points_{model}"
    return run


for _m in ("rbf", "l2", "l1", "cosine"):
    QUERIES[f"change_points_{_m}"] = _kernel(_m)


@query()
def penalty_elbow(spark, d):
    return K.penalty_elbows(_signal(spark, d), "episode", "frame", "v").drop("runtime_s")


@query()
def segmenters(spark, d):
    return K.segmenter_benchmark(_signal(spark, d), "episode", "frame", "v", ChangeConfig(model="l2", penalty=50_000.0)).drop("runtime_s")


@query()
def primitives(spark, d):
    return K.primitives(_signal(spark, d), "episode", "frame", "v", ChangeConfig(model="rbf", penalty=1.0), PrimitiveConfig(window=3, k=2, beta=5.0, max_iter=10)).drop("runtime_s")


@query()
def lowpass(spark, d):
    return K.lowpass_series(trajectories(spark, d), "episode", "frame", "x", rate=30.0)


#: A two-link planar arm.
ARM = """<robot name="arm"><link name="base"/><link name="upper"/><link name="lower"/><link name="tip"/>
<joint name="j1" type="revolute"><parent link="base"/><child link="upper"/><axis xyz="0 0 1"/></joint>
<joint name="j2" type="revolute"><parent link="upper"/><child link="lower"/><origin xyz="1 0 0"/><axis xyz="0 0 1"/></joint>
<joint name="end" type="fixed"><parent link="lower"/><child link="tip"/><origin xyz="0.5 0 0"/></joint></robot>"""


@query(
    """WITH v AS (SELECT CAST(label AS BIGINT) AS episode, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)
SELECT episode, frame, round(cos(a) + 0.5 * cos(a + b), 6) AS px, round(sin(a) + 0.5 * sin(a + b), 6) AS py, round(abs(sin((a + b) / 2)), 6) AS qz FROM v"""
)
def forward_kinematics(spark, d):
    j = K.forward_kinematics(joints(spark, d).select("episode", "frame", "q"), "q", ARM, ["j1", "j2"], "tip")
    p = [F.element_at("ee_pose", k) for k in (1, 2, 6)]
    return rounded(j.select("episode", "frame", p[0].alias("px"), p[1].alias("py"), F.abs(p[2]).alias("qz")), "px", "py", "qz")


@query(f"WITH w AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{BLANK}', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_tokens FROM w")
def text_tokens(spark, d):
    """Sum of the chunks of each text: its number of tokens."""
    s = segment_texts(table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", F.aggregate(F.map_values("label_lengths"), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_tokens"))


@query()
def text_segments(spark, d):
    return segment_texts(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "num_segments", F.to_json("label_lengths").alias("label_lengths"))


@query()
def pipeline_summary(spark, d):
    found = pipeline_boundaries(_signal(spark, d), "episode", "frame", "v", ChangeConfig(model="l2", penalty=50_000.0))
    stats, _ = summarise(found, "episode", 10.0)
    return stats


@query()
def pipeline_agreement(spark, d):
    found = pipeline_boundaries(_signal(spark, d), "episode", "frame", "v", ChangeConfig(model="l2", penalty=50_000.0))
    return summarise(found, "episode", 10.0)[1]
