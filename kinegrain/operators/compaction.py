"""Consolidation of many small files into a few well-sized, sorted ones.

Records are range-partitioned by their clustering keys (Spark samples the key range for the
boundaries; the number of ranges follows from the total bytes and the target size of a file), sorted
within a range, reduced to one record per key and written, one file per range. The result goes to a
staging folder; only when its counts agree with the input are the folders swapped.

A range never holds part of a key, so records repeated within or between files meet in one task, and
one key's copies are reduced while they stream by. ``n_rows`` and ``n_files`` tell how many records
and how many different files held the key. Of differing records of one key, the one of the smallest
file id is kept.

Defined cases: records with a null among their keys name no record, so only those that agree in every
column count as copies and all others stay; records without a file id count as no file; empty input
gives an empty table; an input that has the result's own columns raises ValueError.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrain.runtime import hadoop_path
from kinegrain.sources.tables import c

COUNTS = ("n_rows", "n_files")
LONE = "__lone"


def _summary(df: DataFrame, keys: list[str], weight: str | None) -> tuple[int, int]:
    """Number of source records and a sum over the hashes of their keys, whatever their order."""
    w = F.col(weight).cast("decimal(38,0)") if weight else F.lit(1).cast("decimal(38,0)")
    mark = F.pmod(F.xxhash64(*[c(k) for k in keys]), F.lit(1 << 31)).cast("decimal(38,0)")
    row = df.agg(F.sum(w).alias("n"), F.sum(w * mark).alias("h")).first()
    return int(row["n"] or 0), int(row["h"] or 0)


UNKNOWN_BYTES = 1 << 60
MOST_RANGES = 100_000


def input_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` reads, as the planner knows it; else rows times the width of their types."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < UNKNOWN_BYTES else df.count() * int(df._jdf.schema().defaultSize())


def compact(df: DataFrame, keys: list[str], file_id: str, target: str, total_bytes: int | None = None, target_bytes: int = 128 << 20) -> DataFrame:
    """Write ``df`` to the folder ``target`` as sorted files of about ``target_bytes``; return it.

    Every key is held exactly once, with all other columns and n_rows, n_files. Raises RuntimeError,
    leaving ``target`` as it was, if records were lost or doubled on the way.
    """
    spark = df.sparkSession
    recover(spark, target)
    clash = {*COUNTS, LONE} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    total = total_bytes if total_bytes is not None else input_bytes(df)
    ranges = min(MOST_RANGES, max(1, math.ceil(total / target_bytes)))
    rest = [x for x in df.columns if x not in keys]
    unnamed = F.lit(False)
    for k in keys:
        unnamed = unnamed | c(k).isNull()
    by = [*[c(k) for k in keys], F.col(LONE)]
    one = (
        df.withColumn(LONE, F.when(unnamed, F.xxhash64(*[c(x) for x in df.columns])))
        .repartitionByRange(ranges, *by)
        .groupBy(*by)
        .agg(F.min_by(F.struct(*[c(x) for x in rest]), c(file_id)).alias("__r"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(c(file_id)).alias("n_files"))
    )
    return _swap_in(spark, df, one, keys, rest, target)


def recover(spark: SparkSession, target: str) -> bool:
    """Put the former table back where a swap was cut off between its two renames; whether one was."""
    fs, place = hadoop_path(spark, target)
    if fs.exists(place):
        return False
    _, pattern = hadoop_path(spark, f"{target}.old-*")
    found = fs.globStatus(pattern)
    if found is None or len(found) != 1:
        return False
    return bool(fs.rename(found[0].getPath(), place))


def _swap_in(spark: SparkSession, df: DataFrame, one: DataFrame, keys: list[str], rest: list[str], target: str) -> DataFrame:
    staging = f"{target}.staging-{uuid.uuid4().hex[:8]}"
    out = one.select(*[c(k) for k in keys], *[F.col("__r").getField(x).alias(x) for x in rest], *COUNTS)
    out.sortWithinPartitions(*[c(k) for k in keys]).write.option("compression", "zstd").parquet(staging)
    return _reconcile(spark, df, keys, staging, target)


def _reconcile(spark: SparkSession, df: DataFrame, keys: list[str], staging: str, target: str) -> DataFrame:
    fs, new = hadoop_path(spark, staging)
    written = spark.read.parquet(staging)
    before, after = _summary(df, keys, None), _summary(written, keys, "n_rows")
    if before != after:
        fs.delete(new, True)
        raise RuntimeError(f"compaction isn't whole: {before} records and key sum before, {after} after")
    _, place = hadoop_path(spark, target)
    old = None
    if fs.exists(place):
        _, old = hadoop_path(spark, f"{target}.old-{uuid.uuid4().hex[:8]}")
        if not fs.rename(place, old):
            raise RuntimeError(f"{target} could not be put aside")
    if not fs.rename(new, place):
        if old is not None:
            fs.rename(old, place)
        raise RuntimeError(f"{staging} could not take the place of {target}")
    if old is not None:
        fs.delete(old, True)
    return spark.read.parquet(target)
