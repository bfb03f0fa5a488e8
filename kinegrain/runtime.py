"""Session helpers: the shared work folder, written intermediate tables and file-system calls."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and everything runs on this
    machine (tests, a laptop) a temporary folder is made and remembered in the session; RuntimeError else.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_KEY} is unset: name a folder there that all executors share")
        path = tempfile.mkdtemp(prefix="kinegrain-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The file system of ``path`` and the path itself, as JVM objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the gateway may be gone already
            return


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the program ends."""
    path = f"{shared_dir(spark)}/kinegrain-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage without any copy that lives on one executor only: a lost executor costs
    a re-read, not a re-computation, and the planner sees the true size of the table.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinegrain_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the folder of a written intermediate table that nothing reads any more."""
    path = getattr(df, "_kinegrain_path", None)
    if path is not None:
        delete(df.sparkSession, path)
