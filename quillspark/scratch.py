"""Intermediate tables in the folder that driver and executors share.

Long plans are cut by writing a table once and reading it back: the table
outlives lost executors, and nothing upstream runs twice.  The folder is the
session's ``spark.checkpoint.dir``; only where that is unset (tests, local
mode) a temporary one is made.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspark-"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quillspark/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by :func:`materialize` that nothing reads any more: what was made of them is written by now."""
    for df in tables:
        drop_scratch(df.sparkSession, df.scratch_path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a path made by :func:`scratch_path`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished phases go.

    Spark removes them when the driver's garbage collector finds their plans
    unused, which may be long after; between phases it is asked to look.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            drop_scratch(spark, path)
        except Exception:  # the session may be gone by now
            return
