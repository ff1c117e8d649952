"""An index of chunks that is brought up to date file by file.

Chunks lie in buckets of their file's hash, and beside them the stamps of the files, so that a bucket is always of one
state: an update overwrites the buckets whose files changed (Spark's dynamic partition overwrite) and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.chunking import build_plan, rebuilt, stamped
from skein.scratch import forget, written

BUCKETS = 256
#: Numbers that rows have in the place of a chunk's: a file's stamp, and a bucket's own row, so that none is ever without rows.
STAMP, SELF = -1, -2


def bucket_of(file: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("chunk_idx >= 0").drop("stamp")


def stamps(spark: SparkSession, path: str) -> DataFrame:
    """file, stamp of every file; null where a chunk still has no vector."""
    return spark.read.parquet(path).filter(F.col("chunk_idx") == STAMP).select("file", "stamp", "bucket")


def stamp(sha256: Column, chunker: str, model: str) -> Column:
    """What a file's chunks depend on: its content, how it is cut, and the model of its vectors."""
    return F.concat_ws("/", sha256, F.lit(chunker), F.lit(model))


def update(spark: SparkSession, path: str, files: DataFrame, chunker: Callable[[DataFrame], DataFrame], embed: Callable[[list[str]], list], model: str = "", version: str = "", buckets: int = BUCKETS) -> list[int]:
    """Brings the index to the state of `files` and returns the numbers of the buckets it rewrote.

    files: relpath, sha256, text; chunker: DataFrame of (file, text) to file, chunk_idx, sub_idx, embed_text, ...; embed: list
    of texts to list of vectors (None: tried again next time). `version` names the chunker: another one cuts every file
    anew but keeps the vectors of texts that stay; another model keeps none. The number of buckets is the first build's.

    The plan compares stamps only. Of the touched buckets all files are read, of which the changed ones are cut and embedded;
    what is new is written aside before it replaces them, so that an embedding is made once and a reader's bucket is whole.
    """
    old = _exists(spark, path)
    if old:
        buckets = spark.read.parquet(path).filter(F.col("chunk_idx") == SELF).select(F.max("sub_idx")).first()[0]
    new = files.select("relpath", stamp(F.col("sha256"), version, model).alias("sha256"))
    have = stamps(spark, path).select(F.col("file").alias("relpath"), F.col("stamp").alias("sha256")) if old else new.limit(0)
    plan = build_plan(new, have).filter("action <> 'unchanged'").select("relpath", bucket_of(F.col("relpath"), buckets).alias("bucket"))
    touched = sorted(r[0] for r in plan.select("bucket").distinct().collect()) if old else list(range(buckets))
    if not touched:
        return []
    here = F.col("bucket").isin(touched) if len(touched) < buckets else F.lit(True)
    own = files.withColumn("bucket", bucket_of(F.col("relpath"), buckets)).filter(here).drop("bucket").withColumn("sha256", stamp(F.col("sha256"), version, model))
    if old:
        stored = chunks(spark, path).filter(here).filter(F.col("model") == model).drop("bucket", "model")
        have = stamps(spark, path).filter(here).select(F.col("file").alias("relpath"), F.col("stamp").alias("sha256"))
    else:
        shape = chunker(files.limit(0).select(F.col("relpath").alias("file"), "text"))
        stored = shape.withColumn("chunk_hash", F.lit("")).withColumn("embedding", F.array().cast("array<double>"))
    rows, _ = rebuilt(own, have, stored, chunker, embed)
    rows = written(rows.withColumn("model", F.lit(model)), "index-chunks")  # its vectors are used twice: here, and for the stamps
    marks = stamped(own.select("relpath", "sha256"), rows)
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in rows.dtypes}
    mark = marks.select(*[{"file": F.col("relpath").alias("file"), "chunk_idx": F.lit(STAMP).alias("chunk_idx")}.get(c, x) for c, x in empty.items()], F.col("sha256").alias("stamp"))
    selves = spark.createDataFrame([(b,) for b in touched], "bucket int")
    self_ = selves.select(*[{"chunk_idx": F.lit(SELF).alias("chunk_idx"), "sub_idx": F.lit(buckets).alias("sub_idx")}.get(c, x) for c, x in empty.items()], F.lit(None).cast("string").alias("stamp"), "bucket")
    out = rows.withColumn("stamp", F.lit(None).cast("string")).unionByName(mark).withColumn("bucket", bucket_of(F.col("file"), buckets)).unionByName(self_)
    kinds = dict(spark.read.parquet(path).dtypes) if old else {}
    out = out.select(*[F.col(c).cast(kinds.get(c, t)).alias(c) for c, t in out.dtypes])
    # dealt by bucket, where a large one may be split and small ones share a task
    out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    forget(rows)
    return touched
