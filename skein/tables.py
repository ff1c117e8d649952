"""The driver's tables in the engine's canonical shapes, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors: two fragments a chunk, a file for each label, four corpora."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("c"), F.col("label") % 4).alias("corpus"), F.concat(F.lit("threads/"), F.col("label")).alias("file"),
        F.expr("vec_id div 2").alias("chunk_idx"), (F.col("vec_id") % 2).cast("int").alias("sub_idx"), "vec_id", "label",
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


CHUNKS = """chunks AS (SELECT 'c' || (label % 4) AS corpus, 'threads/' || label AS file, vec_id // 2 AS chunk_idx,
    (vec_id % 2)::INT AS sub_idx, vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages of a thread: the first four reply to the first, later ones to the turn three before."""
    c = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") == 0, None).when(F.col("turn") < 4, 0).otherwise(F.col("turn") - 3)
    return c.select(F.col("conv_id").alias("thread"), F.col("turn").alias("idx"), parent.cast("long").alias("parent"), F.col("role").alias("sender"), F.coalesce("text", F.lit("")).alias("body"))


MESSAGES = """messages AS (SELECT conv_id AS thread, turn AS idx, CASE WHEN turn = 0 THEN NULL WHEN turn < 4 THEN 0 ELSE turn - 3 END::BIGINT AS parent,
    role AS sender, coalesce(text, '') AS body FROM conversations)"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues: open ones have status O, priority is the label, the order date the last update."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("r"), F.col("o_custkey") % 5).alias("repo"), F.col("o_orderkey").cast("long").alias("number"), F.col("o_custkey").cast("long").alias("author"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "merged").otherwise("closed").alias("state"),
        F.lower("o_orderpriority").alias("label"), F.to_date("o_orderdate").alias("updated"), F.col("o_totalprice").cast("double").alias("weight"),
    )


ISSUES = """issues AS (SELECT 'r' || (o_custkey % 5) AS repo, o_orderkey::BIGINT AS number, o_custkey::BIGINT AS author,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'merged' ELSE 'closed' END AS state, lower(o_orderpriority) AS label,
    o_orderdate::DATE AS updated, o_totalprice::DOUBLE AS weight FROM orders)"""
