"""Running sums and ranks that no single task has to hold, even if one key has most of the rows or there is no key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.scratch import written

#: Rows that one task may order: up to there a plain window is enough, and nothing is written.
FEW_ROWS = 1 << 18


def dealt(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """`df` as a table in which `_p` numbers ranges of keys and order: a range stands before those of greater numbers."""
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_p", F.spark_partition_id())
    return written(spread, name)


def joined(rows: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns that `before` has for their keys (null like any value) and range."""
    named = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), *[c for c in before.columns if c not in (*keys, "_p")])
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, same).drop("_q", *(f"_k{i}" for i in range(len(keys))))


def running(df: DataFrame, keys: list[str], order: list[Column], size: Column, name: str) -> DataFrame:
    """`df` with `name`: the sum of `size` over the rows of the same keys up to and including this one, in the order given (which must be total).

    Rows are dealt by ranges of keys and order; the totals of the ranges (one row for each range and key) give what stands
    before a range, and a window runs within one range only.
    """
    cols, until = df.columns, (Window.unboundedPreceding, 0)
    if df.count() <= FEW_ROWS:
        return df.withColumn(name, F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*until)))
    rows = dealt(df.withColumn("_size", size), keys, order, "ranks")
    totals = rows.groupBy(*keys, "_p").agg(F.sum("_size").alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_n")).drop("_n")
    inside = F.sum("_size").over(Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(*until))
    return joined(rows.withColumn("_inside", inside), before, keys).select(*cols, (F.col("_inside") + F.col("_before")).alias(name))


def highest(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """`df` with the highest `value` among the rows of the same keys before this one, null if there is none."""
    cols, before_it = df.columns, (Window.unboundedPreceding, -1)
    if df.count() <= FEW_ROWS:
        return df.withColumn(name, F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before_it)))
    rows = dealt(df, keys, order, "highest")
    inside = F.max(value).over(Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(*before_it))
    return joined(rows.withColumn("_inside", inside), ahead(rows, keys, value), keys).select(*cols, F.greatest("_inside", "_before").alias(name))


def ahead(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, _p and `_before`: the highest value of all ranges before. rows: as of `dealt`."""
    ends = rows.groupBy(*keys, "_p").agg(F.max(value).alias("_end"))
    return ends.withColumn("_before", F.max("_end").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`df` with `value` of the row before among those of the same keys, null for the first; `order` ascends and is total."""
    cols = df.columns
    if df.count() <= FEW_ROWS:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    rows = dealt(df, keys, [F.col(c) for c in order], "previous")
    ends = rows.groupBy(*keys, "_p").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_p"))).drop("_end")
    along = Window.partitionBy(*keys, "_p").orderBy(*order)
    first = F.row_number().over(along) == 1
    return joined(rows.withColumn("_own", F.lag(value).over(along)).withColumn("_first", first), before, keys).select(*cols, F.when(F.col("_first"), F.col("_before.v")).otherwise(F.col("_own")).alias(name))


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """`df` with the place (from 1) of each row among those of its keys."""
    return running(df, keys, order, F.lit(1).cast("long"), name)
