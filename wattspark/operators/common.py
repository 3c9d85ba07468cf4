"""Helpers for summaries that are joined back, and for cutting the lineage of iterative jobs."""

import atexit
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: list[DataFrame] = []

# A side counted at or below this many rows may be sent to every executor. Rows here are a
# handful of numbers and short keys, so this stays in the tens of megabytes.
BROADCAST_ROWS = 200_000


def settle(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    The plan starts anew, lost executors cost nothing, and the stored table has a real size: a
    later join on it is broadcast by Spark only when it is below
    `spark.sql.autoBroadcastJoinThreshold`; a larger one takes the shuffle join with AQE skew
    handling. `options` go to the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Persist lazily (used for row-level inputs read by several passes)."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(kept)
    return kept


def release(spark: SparkSession | None = None) -> None:
    """Drop every relation kept by this library and, given the session, this run's stored tables.

    Frames made from stored tables before this call can't be read any more.
    """
    while _kept:
        _kept.pop().unpersist()
    if spark is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's `spark.checkpoint.dir`.

    Only a local session without the setting (all tasks in one process, as in tests) gets a temporary
    folder, which goes when the process ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="wattspark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark reads it from, so that tasks which open files themselves use the same one."""
    bare = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bare.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(bare).toString()


def run_dir(spark: SparkSession) -> str:
    """The folder of this run's tables, below the shared folder."""
    return f"{qualified(spark, shared_dir(spark)).rstrip('/')}/wattspark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the folder of this run."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows_per_task: int) -> DataFrame:
    """Spread a stored table over enough tasks before a step that multiplies its rows."""
    tasks = min(-(-df.count() // rows_per_task), 20_000)
    return df.repartition(tasks) if tasks > 1 else df


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a side whose row count was measured and is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def attach_one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of an ungrouped aggregate (exactly one row) to every row."""
    return df.crossJoin(F.broadcast(row))


def valid(c: str) -> Column:
    """Neither NULL nor NaN."""
    return F.col(c).isNotNull() & ~F.isnan(F.col(c))


def sq_distance(a: list[Column], b: list[Column]) -> Column:
    """Squared Euclidean distance, summed in column order."""
    total = None
    for x, y in zip(a, b):
        part = (x - y) * (x - y)
        total = part if total is None else total + part
    return total
