"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete the shuffle files of a query when it ends, not when the driver's collector finds its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where the session names none, a temporary one in local mode; on a cluster ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="roadweft-"))
        found = _own[0]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes with clear(), or when Python ends."""
    path = f"{shared_dir(spark)}/roadweft/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back, so that no lineage hangs on executors.

    The shuffle files of the write go when it has ended: only the table is read again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path that fresh_path() gave."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written.pop(path, None)


def remove(*staged: DataFrame) -> None:
    """Delete the files of tables, as stage() gave them, that no later step reads."""
    for df in staged:
        discard(df.sparkSession, df.staged_path)


def clear() -> None:
    """Delete all that has been written to the shared folder; results that are still to be computed from it are lost."""
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is None:  # stopped
            _written.pop(path)
        else:
            discard(spark, path)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session's JVM may be gone
        clear()
