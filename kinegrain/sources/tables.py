"""Readers of the project's tables and the resolution of frames to episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "observation.state"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def c(name: str) -> Column:
    """A column whose name may hold a dot."""
    return F.col(f"`{name}`")


def episode_of_path(path: Column) -> Column:
    """Episode number in ``.../episode_<number>.parquet``, with or without leading zeros; else null."""
    digits = F.regexp_extract(path, r"episode_0*([0-9]+)[^/]*\.parquet$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def resolve_episodes(frames: DataFrame, files: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of frames with ``episode_index`` filled from the file name where it is null.

    Only rows without an episode are joined, and only with files whose name tells one, so the
    large side is never shuffled for this. Rows whose episode stays unknown keep null. Repeated
    rows of ``files`` count once.
    """
    want = [c(x) for x in columns if x != "episode_index"]
    known = frames.where(F.col("episode_index").isNotNull()).select("episode_index", *want)
    names = (
        files.select("file_id", episode_of_path(F.col("file_path")).alias("__episode"))
        .where(F.col("file_id").isNotNull() & F.col("__episode").isNotNull())
        .groupBy("file_id")
        .agg(F.min("__episode").alias("__episode"))
    )
    lost = frames.where(F.col("episode_index").isNull())
    keep = [x for x in dict.fromkeys([*columns, "file_id"]) if x != "episode_index"]
    found = lost.select(*[c(x) for x in keep]).join(names, "file_id", "left")
    return known.unionByName(found.select(F.col("__episode").alias("episode_index"), *want))


def clean_episodes(episodes: DataFrame) -> DataFrame:
    """One row per ``episode_index`` with its robot and fps (null, NaN or not positive: 30).

    Repeated rows count once. Where rows of one episode differ, the smallest fps and robot count,
    so that the result doesn't hang on their order. Rows without ``episode_index`` are left out.
    """
    fps = F.col("fps").cast("double")
    return (
        episodes.where(F.col("episode_index").isNotNull())
        .groupBy("episode_index")
        .agg(F.min(F.when((fps > 0) & ~F.isnan(fps), fps)).alias("fps"), F.min("robot_id").alias("robot_id"))
        .withColumn("fps", F.coalesce("fps", F.lit(30.0)))
    )
