"""What the operators share: scratch tables in the cluster's shared folder, and session settings."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import sys
import tempfile
from pathlib import Path

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

from skein.scratch import forget, scratch_dir, written

__all__ = ["drained", "forget", "parts", "scratch_dir", "shipped", "trimmed", "tuned", "written"]


#: Rows of an Arrow batch at most.
BATCH_ROWS = 512


def shipped(spark: SparkSession) -> None:
    """Sends the package to Python workers that wouldn't find it: those not started in its folder or with it on PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if any(x and Path(x).resolve() == root for x in known) or getattr(context, "_skein_sent", False):
        return
    name = os.path.join(tempfile.mkdtemp(), "skein")
    context.addPyFile(shutil.make_archive(name, "zip", root, "skein"))
    context._skein_sent = True


def tuned(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough for very long texts in a small Python worker, for this session; a smaller bound stays."""
    shipped(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def trimmed() -> None:
    """Gives memory that a fit on the driver no longer needs back to the system, as other stages need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


#: Deletes a query's shuffle files when it ends; they cost nothing where nobody runs the same plan again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def drained(df: DataFrame, name: str) -> DataFrame:
    """As `written`, for a plan that isn't run again: what it shuffled is gone from the disks before the next plan shuffles."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(CLEANUP, before)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
