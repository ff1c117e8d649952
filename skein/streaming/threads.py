"""Conversations kept up to date as messages arrive, late and in any order.

Messages are stored with their conversations in buckets of their root's subject. A batch touches the buckets of messages it
repeats, of those that name one of its ids, of those that it names, and of its own subjects; these are assembled anew with
the batch, all others stay as they are. A message's parent is always of the same root, so a bucket needs no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.threads import forest, subject_key
from skein.scratch import forget, written

BUCKETS = 256
#: The bucket of messages without a root, which any arrival may give one: it is always read.
ROOTLESS = 0
COLUMNS = ["corpus", "message_id", "subject", "date", "in_reply_to", "references", "path"]
FOUND = ["parent_id", "root", "key", "thread", "place"]


def _bucket(key: Column, buckets: int) -> Column:
    """By the subject alone, as a tree may reach over corpora."""
    return (F.pmod(F.xxhash64(key), F.lit(buckets)) + 1).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(path).filter("message_id IS NOT NULL")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """What `assembled` gives for all messages that have arrived."""
    return _stored(spark, path).filter("thread IS NOT NULL").select("message_id", "parent_id", "thread", "corpus", "subject", "date", "place")


def _names(rows: DataFrame) -> DataFrame:
    """message_id, ref: what messages name as earlier ones."""
    every = F.array_union(F.coalesce("references", F.array().cast("array<string>")), F.array("in_reply_to"))
    return rows.select("message_id", F.explode(every).alias("ref")).filter("ref IS NOT NULL")


def arrive(batch: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Adds messages to the store and returns the buckets that were written. batch: COLUMNS.

    Of the store, ids and references are scanned to find the touched buckets; only those are read whole, assembled and
    replaced (by dynamic partition overwrite). The number of buckets is that of the first batch.
    """
    spark = batch.sparkSession
    batch = written(batch.select(*COLUMNS), "arrived")
    own = batch.select(_bucket(subject_key(F.col("subject")), buckets).alias("bucket"))
    old = _stored(spark, path)
    if old is not None:
        buckets = spark.read.parquet(path).filter("message_id IS NULL").select(F.max("place")).first()[0]
        own = batch.select(_bucket(subject_key(F.col("subject")), buckets).alias("bucket"))
        ids = batch.select("message_id").distinct()
        named = _names(batch).select(F.col("ref").alias("message_id")).distinct()
        repeated = old.join(ids.unionByName(named).distinct(), "message_id", "left_semi").select("bucket", "subject")
        naming = _names(old).join(ids.withColumnRenamed("message_id", "ref"), "ref", "left_semi").select("message_id").distinct()
        hit = repeated.unionByName(old.join(naming, "message_id", "left_semi").select("bucket", "subject"))
        own = own.unionByName(hit.select("bucket")).unionByName(hit.select(_bucket(subject_key(F.col("subject")), buckets).alias("bucket")))
    touched = sorted({ROOTLESS, *(r.bucket for r in own.distinct().collect())})  # as many as there are buckets at most
    rows = batch if old is None else old.filter(F.col("bucket").isin(touched)).select(*COLUMNS).unionByName(batch)
    place = F.when(F.col("root").isNull(), ROOTLESS).otherwise(_bucket(F.coalesce("key", F.lit("")), buckets))
    got = written(forest(rows).select(*COLUMNS, *FOUND, place.alias("bucket")), "arrived-forest")
    kinds = dict(got.dtypes)
    selves = spark.createDataFrame([(b, buckets) for b in touched], "bucket int, place int").select(*[F.lit(None).cast(kinds[c]).alias(c) if c not in ("bucket", "place") else F.col(c).cast(kinds[c]).alias(c) for c in got.columns])
    got.unionByName(selves).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    forget(got)
    forget(batch)
    return touched


def kept(messages: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """`arrive` for each micro-batch of a stream; a batch that is run again finds its own messages and changes nothing."""
    return messages.writeStream.foreachBatch(lambda batch, _: arrive(batch, path, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
