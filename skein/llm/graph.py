"""Connected components of an edge list by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _star_step(e: DataFrame) -> DataFrame:
    """Both steps on edges u > v: neighbours move to the least node around, which only shortens paths within a component."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    near = large.join(low, "u")
    small = near.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _is_forest(e: DataFrame) -> bool:
    """Whether every node hangs directly below the least one of its component: it is one edge's u, or only a v."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v long, either way round, loops and repeats allowed. Returns node, component (the least node reachable).

    Only nodes with an edge to another node are returned. Each round is a table in the shared folder; the rounds grow
    with the logarithm of the longest path, and end once all trees are flat. No edge list reaches the driver.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    while not _is_forest(now):
        old, now = now, written(_star_step(now), "stars")
        forget(old)
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
