"""Queries p2 to p5: the general training-data operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrain.operators.anomalies import implausible
from kinegrain.operators.compaction import compact, input_bytes
from kinegrain.operators.drift import SPELLINGS, consistent_rows, fold_types, header_cells, list_files, lost_values, read_headers, schema_changes, union_schema
from kinegrain.operators.gridfill import regular_grid
from kinegrain.runtime import work_path
from kinegrain.sources.tables import resolve_episodes, table

#: Size of a consolidated file in these queries, in bytes of the input.
FILE_BYTES = 32 << 20


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = [table(spark, sf_dir, x) for x in ("frames", "frame_files", "episodes", "robots", "joint_limits")]
    return implausible(*t).select("episode_index", "frame_index", "field_name", "channel")


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p2_found, counted by robot's field, channel and kind of fault."""
    t = [table(spark, sf_dir, x) for x in ("frames", "frame_files", "episodes", "robots", "joint_limits")]
    return implausible(*t).groupBy("field_name", "channel", "kind").agg(F.count(F.lit(1)).alias("n_elements"), F.count_distinct("episode_index").alias("n_episodes"))


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "frames")
    known = resolve_episodes(frames, table(spark, sf_dir, "frame_files"), frames.columns)
    return compact(known, ["episode_index", "frame_index"], "file_id", work_path(spark, "frames-compact"), input_bytes(frames), FILE_BYTES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.col("n_files") > 1
    return consolidated(spark, sf_dir).where(held & F.col("episode_index").isNotNull() & F.col("frame_index").isNotNull()).select("episode_index", "frame_index")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per episode, how many records went in and how many distinct frames came out."""
    return consolidated(spark, sf_dir).where("episode_index is not null").groupBy("episode_index").agg(F.sum("n_rows").alias("n_in"), F.count(F.lit(1)).alias("n_out"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "dataset_schemas")).select("dataset_id", "snapshot_id", "change_kind", "key_name")


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_rows(table(spark, sf_dir, "dataset_rows"), table(spark, sf_dir, "dataset_schemas"))


def p4_union_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_schema(table(spark, sf_dir, "dataset_schemas"))


def p4_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the lattice widens, narrows, merges or can't hold the types of a change."""
    return schema_changes(table(spark, sf_dir, "dataset_schemas")).where("change_kind = 'retyped'").groupBy("was", "now", "verdict").agg(F.count(F.lit(1)).alias("n_changes"))


def p4_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each key, and those that the cast to its type loses."""
    return lost_values(table(spark, sf_dir, "dataset_rows"), table(spark, sf_dir, "dataset_schemas"))


def p4_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all tables' files, from their footers, with the least type that holds them all; fails when a footer can't be read."""
    return fold_types(header_cells(read_headers(list_files(spark, sf_dir))))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(*[table(spark, sf_dir, x) for x in ("frames", "frame_files", "episodes")])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).where("filled").select("episode_index", "slot_index")


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


QUERIES = {f.__name__: f for f in (p2_found, p2_flags, p3_found, p3_counts, p4_found, p4_rows, p4_union_schema, p4_verdicts, p4_lost, p4_headers, p5_found, p5_grid)}

_FRAMES = r"""(SELECT coalesce(f.episode_index, TRY_CAST(nullif(regexp_extract(ff.file_path, 'episode_0*([0-9]+)[^/]*\.parquet$', 1), '') AS BIGINT)) AS e, f.*
  FROM frames f LEFT JOIN (SELECT DISTINCT file_id, file_path FROM frame_files) ff USING (file_id))"""

_ROLES = ("joint_state_key", "joint_command_key", "ee_pose_key", "gripper_key", "timestamp_key", "episode_index_key", "frame_index_key")
_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items() if a != b)
_DATASETS = rf"""one AS (SELECT * FROM dataset_schemas WHERE snapshot_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY loaded_at DESC NULLS LAST, inspected_at DESC NULLS LAST) = 1),
  good AS (SELECT * FROM one WHERE all_keys IS NOT NULL),
  flat AS (SELECT snapshot_id AS s, unnest(range(1, len(all_keys) + 1)) AS i, all_keys, all_types FROM good),
  typed AS (SELECT s, i, coalesce(lower(regexp_replace(all_keys[i], '^\s+|\s+$', '', 'g')), '') AS k,
    replace(regexp_replace(lower(all_types[i]), '\s+', '', 'g'), 'list<', 'array<') AS t FROM flat),
  spelled AS (SELECT s, i, k, regexp_extract(t, '^(?:array<)*([^<>]*)>*$', 1) AS inr, t FROM typed),
  keys AS (SELECT s, k, coalesce(replace(t, inr, CASE inr {_CASES} ELSE inr END), 'null') AS t FROM spelled QUALIFY row_number() OVER (PARTITION BY s, k ORDER BY i) = 1)"""
_FOLD = """SELECT k AS key_name, CASE WHEN len(t) = 0 THEN 'string' WHEN len(t) = 1 THEN t[1]
  WHEN len(list_filter(t, lambda x: x[:6] <> 'array<')) = 0 THEN 'array<' || met(list_transform(t, lambda x: x[7:-2])) || '>' ELSE met(t) END AS key_type
FROM (SELECT k, list_sort(list(DISTINCT t) FILTER (WHERE t <> 'null')) AS t FROM cells GROUP BY k)""".replace("met(list_transform(t, lambda x: x[7:-2]))", "@1").replace("met(t)", "@2")


def _met(t: str) -> str:
    """What a list of different types becomes."""
    numeric = "('boolean', 'int', 'bigint', 'float', 'double')"
    has = lambda x: f"list_contains({t}, '{x}')"
    return (
        f"CASE WHEN len({t}) = 1 THEN ({t})[1] WHEN len(list_filter({t}, lambda y: y NOT IN {numeric})) > 0 THEN 'string' WHEN {has('double')} OR ({has('float')} AND ({has('int')} OR {has('bigint')})) THEN 'double'"
        f" WHEN {has('float')} THEN 'float' WHEN {has('bigint')} THEN 'bigint' ELSE 'int' END"
    )


_FOLD = _FOLD.replace("@1", _met("list_distinct(list_transform(t, lambda x: x[7:-2]))")).replace("@2", _met("t"))
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "frames", "frame_files", "episodes", "segments", "dataset_schemas", "dataset_rows", "robots", "joint_limits", "pack_targets")

SQL = {
    "p4_found": f"""WITH {_DATASETS},
  step AS (SELECT dataset_id AS d, snapshot_id AS s, layout, lag(snapshot_id) OVER w AS p, lag(layout) OVER w AS old FROM good WINDOW w AS (PARTITION BY dataset_id ORDER BY inspected_at, snapshot_id)),
  pairs AS (SELECT * FROM step WHERE p IS NOT NULL),
  roles AS ({" UNION ALL ".join(f"SELECT snapshot_id AS s, '{r}' AS r, lower(trim({r})) AS k FROM good" for r in _ROLES)}),
  moved AS (SELECT DISTINCT x.d, x.s, x.p, a.k AS old, b.k AS new FROM pairs x JOIN roles a ON a.s = x.p JOIN roles b ON b.s = x.s AND b.r = a.r
    WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND a.k <> b.k AND NOT EXISTS (SELECT 1 FROM keys WHERE keys.s = x.s AND keys.k = a.k) AND NOT EXISTS (SELECT 1 FROM keys WHERE keys.s = x.p AND keys.k = b.k)),
  was AS (SELECT x.d, x.s, x.p, keys.k, t, coalesce(m.new, keys.k) AS n, m.new IS NOT NULL AS gone FROM pairs x JOIN keys ON keys.s = x.p LEFT JOIN moved m ON m.s = x.s AND m.old = keys.k),
  now AS (SELECT x.d, x.s, keys.k, t, EXISTS (SELECT 1 FROM moved m WHERE m.s = x.s AND m.new = keys.k) AS come FROM pairs x JOIN keys ON keys.s = x.s)
SELECT d AS dataset_id, s AS snapshot_id, 'layout' AS change_kind, layout AS key_name FROM pairs WHERE layout IS DISTINCT FROM old
UNION ALL SELECT d, s, 'renamed', new FROM moved
UNION ALL SELECT d, s, 'added', k FROM now WHERE NOT come AND NOT EXISTS (SELECT 1 FROM was WHERE was.s = now.s AND was.k = now.k)
UNION ALL SELECT d, s, 'removed', k FROM was WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM now WHERE was.s = now.s AND was.k = now.k)
UNION ALL SELECT now.d, now.s, 'retyped', now.k FROM now JOIN was ON was.s = now.s AND was.n = now.k AND was.t <> now.t""",
    "p4_verdicts": f"""WITH {_DATASETS},
  step AS (SELECT dataset_id AS d, snapshot_id AS s, lag(snapshot_id) OVER (PARTITION BY dataset_id ORDER BY inspected_at, snapshot_id) AS p FROM good), pairs AS (SELECT * FROM step WHERE p IS NOT NULL),
  roles AS ({" UNION ALL ".join(f"SELECT snapshot_id AS s, '{r}' AS r, lower(trim({r})) AS k FROM good" for r in _ROLES)}),
  moved AS (SELECT DISTINCT x.s, a.k AS old, b.k AS new FROM pairs x JOIN roles a ON a.s = x.p JOIN roles b ON b.s = x.s AND b.r = a.r
    WHERE a.k <> b.k AND NOT EXISTS (SELECT 1 FROM keys WHERE keys.s = x.s AND keys.k = a.k) AND NOT EXISTS (SELECT 1 FROM keys WHERE keys.s = x.p AND keys.k = b.k)),
  was AS (SELECT x.s, t, coalesce(m.new, keys.k) AS n FROM pairs x JOIN keys ON keys.s = x.p LEFT JOIN moved m ON m.s = x.s AND m.old = keys.k),
  two AS (SELECT was.t AS was, keys.t AS now, CASE WHEN was.t LIKE 'array<%' AND keys.t LIKE 'array<%' THEN [was.t[7:-2], keys.t[7:-2]] ELSE [was.t, keys.t] END AS t, was.t LIKE 'array<%' AND keys.t LIKE 'array<%' AS lists FROM was JOIN keys ON keys.s = was.s AND keys.k = was.n AND keys.t <> was.t),
  met AS (SELECT was, now, CASE WHEN lists THEN 'array<' || ({_met("t")}) || '>' ELSE {_met("t")} END AS met FROM two)
SELECT was, now, CASE WHEN met = now THEN 'widened' WHEN met = was THEN 'narrowed' WHEN met LIKE '%string%' THEN 'incompatible' ELSE 'merged' END AS verdict, count(*) AS n_changes FROM met GROUP BY 1, 2, 3""",
    "p4_union_schema": f"WITH {_DATASETS}, cells AS (SELECT k, t FROM keys) {_FOLD}",
    "p4_headers": f"""WITH cells AS (SELECT lower(trim(column_name)) AS k, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'BOOLEAN' THEN 'boolean'
    WHEN 'DATE' THEN 'date' WHEN 'DOUBLE[]' THEN 'array<double>' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'VARCHAR[]' THEN 'array<string>' WHEN 'INTEGER[]' THEN 'array<int>' WHEN 'BIGINT[]' THEN 'array<bigint>' ELSE CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' ELSE lower(data_type) END END AS t
  FROM information_schema.columns WHERE table_name IN {_TABLES}) {_FOLD}""",
    "p3_found": f"SELECT e AS episode_index, frame_index FROM {_FRAMES} WHERE e IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT file_id) > 1",
    "p3_counts": f"SELECT e AS episode_index, CAST(count(*) AS BIGINT) AS n_in, count(DISTINCT frame_index) AS n_out FROM {_FRAMES} WHERE e IS NOT NULL GROUP BY 1",
    "p5_found": f"""WITH f AS {_FRAMES},
  fp AS (SELECT episode_index AS e, coalesce(min(CASE WHEN fps > 0 THEN fps END), 30) AS fps FROM episodes GROUP BY 1),
  t0 AS (SELECT e, min("timestamp") AS t0 FROM f GROUP BY 1),
  o AS (SELECT DISTINCT e, CAST(round(("timestamp" - t0) * coalesce(fps, 30)) AS BIGINT) AS s FROM f JOIN t0 USING (e) LEFT JOIN fp USING (e)
        WHERE "timestamp" IS NOT NULL AND len(list_filter("observation.state", lambda v: v IS NOT NULL AND NOT isnan(v))) > 0),
  r AS (SELECT e, min(s) AS a, max(s) AS b FROM o GROUP BY 1),
  every AS (SELECT e, unnest(range(a, b + 1)) AS s FROM r)
SELECT e AS episode_index, s AS slot_index FROM every ANTI JOIN o USING (e, s)""",
}
