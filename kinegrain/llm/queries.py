"""Queries p1 and p6 to p9 over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrain.llm.packing import fill_containers
from kinegrain.llm.quantiles import duration_sketches, label_of, merge_sketches, percentiles
from kinegrain.llm.residue import residue, without_residue
from kinegrain.llm.splits import NOTHING, episode_groups, split_frames
from kinegrain.llm.tokens import encode_texts
from kinegrain.sources.tables import resolve_episodes, table

QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label and day."""
    p = percentiles(duration_sketches(table(spark, sf_dir, "segments")), ["label", "run_date"], QUANTILES)
    return p.withColumn("run_date", F.col("run_date").cast("string"))


def p1_label_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label, from the sketches of its days."""
    days = duration_sketches(table(spark, sf_dir, "segments"))
    return percentiles(merge_sketches(days, ["label"]), ["label"], QUANTILES)


def p1_rank_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label, its values, and how many of its percentiles, merged from those of its days, are off by more than the stated error."""
    found = p1_label_percentiles(spark, sf_dir)
    d = F.col("duration")
    one = table(spark, sf_dir, "segments").where(F.col("segment_id").isNotNull() & d.isNotNull() & ~F.isnan(d)).select("segment_id", label_of(F.col("label")).alias("label"), "duration").distinct()
    names = [c for c in found.columns if c[0] == "p" and c[1:].isdigit()]
    joined = one.join(found, one["label"].eqNullSafe(found["label"])).select(one["label"], "duration", "n", "rank_error", *names)
    counts = [x for c in names for x in (F.sum((d < F.col(c)).cast("bigint")).alias(f"{c}_below"), F.sum((d <= F.col(c)).cast("bigint")).alias(f"{c}_upto"))]
    ranked = joined.groupBy("label", "n", "rank_error").agg(*counts)
    off = sum(
        ((F.col(f"{c}_below") + 1 - F.greatest(F.lit(1), F.ceil(q * F.col("n") - 1e-9)) > F.col("rank_error")) | (F.greatest(F.lit(1), F.ceil(q * F.col("n") - 1e-9)) - F.col(f"{c}_upto") > F.col("rank_error"))).cast("bigint")
        for c, q in zip(names, QUANTILES, strict=True)
    )
    return ranked.select("label", "n", off.alias("violations"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = episode_groups(table(spark, sf_dir, "episodes"))
    return g.where("episode_index <> `group`").select(F.col("group").alias("episode_index_a"), F.col("episode_index").alias("episode_index_b"))


def p6_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = resolve_episodes(table(spark, sf_dir, "frames"), table(spark, sf_dir, "frame_files"), ["episode_index", "frame_index"])
    return split_frames(frames, table(spark, sf_dir, "episodes"), SPLITS)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_targets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and share of their room in use, per target."""
    used = p8_containers(spark, sf_dir).where("container is not null").groupBy("target_name", "container").agg(F.sum("n_tokens").alias("used"))
    room = table(spark, sf_dir, "pack_targets").select("target_name", "capacity_tokens").distinct()
    return used.groupBy("target_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens")).join(room, "target_name").withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents")).select("doc_id")


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left."""
    return without_residue(table(spark, sf_dir, "documents")).select("doc_id", "repo", "source")


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_label_percentiles, p1_rank_errors, p6_found, p6_frames, p7_ids, p8_containers, p8_fill, p9_found, p9_kinds, p9_clean)}

# At the size of the comparison every group of a label and a day has fewer values than a sketch holds, so the percentiles are exact.
_P = ", ".join(f"quantile_disc(duration, {q}) AS p{round(q * 100)}" for q in QUANTILES)
_TIE = lambda c: f"nullif(CASE WHEN regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') IN {NOTHING} THEN '' ELSE regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') END, '')"
SQL = {
    "p6_found": f"""WITH RECURSIVE e AS (SELECT DISTINCT episode_index AS e, {_TIE("recording_id")} AS r, {_TIE("workpiece")} AS w, derived_from AS o FROM episodes WHERE episode_index IS NOT NULL),
  star AS (SELECT e AS a, min(e) OVER (PARTITION BY r) AS b FROM e WHERE r IS NOT NULL UNION SELECT e, min(e) OVER (PARTITION BY w) FROM e WHERE w IS NOT NULL UNION SELECT e, o FROM e WHERE o >= 0),
  tie AS (SELECT a, b FROM star WHERE a <> b UNION SELECT b, a FROM star WHERE a <> b),
  reach(a, b) AS (SELECT a, b FROM tie UNION SELECT reach.a, tie.b FROM reach JOIN tie ON reach.b = tie.a)
SELECT min(b) AS episode_index_a, a AS episode_index_b FROM reach WHERE a IN (SELECT e FROM e) AND b IN (SELECT e FROM e) GROUP BY a HAVING min(b) < a""",
    "p1_rank_errors": """WITH s AS (SELECT DISTINCT segment_id, lower(trim(label)) AS label, duration FROM segments WHERE segment_id IS NOT NULL AND duration IS NOT NULL AND NOT isnan(duration))
SELECT label, count(*) AS n, CAST(0 AS BIGINT) AS violations FROM s GROUP BY 1""",
    "p1_percentiles": f"""WITH s AS (SELECT segment_id, lower(trim(label)) AS label, run_date, duration FROM segments WHERE segment_id IS NOT NULL AND duration IS NOT NULL AND NOT isnan(duration)),
  one AS (SELECT DISTINCT * FROM s)
SELECT label, CAST(run_date AS VARCHAR) AS run_date, count(*) AS n, {_P}, CAST(0 AS DOUBLE) AS rank_error FROM one GROUP BY 1, 2""",
}
