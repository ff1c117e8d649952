"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
_MADE: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. On a cluster it has to be set, as executors don't share local folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted like all others."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_at_exit)
    _MADE.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, survives the loss of executors, and is computed once."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _MADE.discard(path)


def forget(df: DataFrame) -> None:
    """Deletes a table made by `written` that nothing reads any more."""
    if getattr(df, "_scratch", None):
        _deleted(df.sparkSession, df._scratch)


def sweep(spark: SparkSession) -> None:
    """Deletes all tables this process has written; results that were not yet stored elsewhere can't be read after it."""
    for path in list(_MADE):
        _deleted(spark, path)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        sweep(spark)
