"""Incremental variants on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(messages: DataFrame, delay: str = "60 days") -> DataFrame:
    """T2 on a stream: one copy of each message id within the delay. messages: message_id, when, ..."""
    return messages.withWatermark("when", delay).dropDuplicatesWithinWatermark(["message_id"])


def activity(events: DataFrame, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Messages and senders of each window; late ones within the delay still count."""
    return events.withWatermark("when", delay).groupBy(F.window("when", window), "kind").agg(F.count("*").alias("n"))


def changed_files(files: DataFrame, stored_path: str, checkpoint: str) -> StreamingQuery:
    """C21 as micro-batches: rows whose hash is not stored yet are appended to a table of (relpath, sha256)."""

    def upsert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.select("relpath", F.sha2("text", 256).alias("sha256")).distinct()
        path = spark._jvm.org.apache.hadoop.fs.Path(stored_path)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(stored_path), ["relpath", "sha256"], "left_anti")
        new.write.mode("append").parquet(stored_path)

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
