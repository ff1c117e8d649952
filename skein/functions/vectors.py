"""Vector arithmetic as native column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is (C17, Q32)."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def quantised(a: Column, scale: float) -> Column:
    """int8 codes: rint(x / scale) within -127 and 127."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x / scale))).cast("tinyint"))


def dequantised(a: Column, scale: float) -> Column:
    """Not normalised again."""
    return F.transform(a, lambda x: x.cast("double") * scale)


def mean_vectors(df: DataFrame, keys: list[str], vector: str = "embedding", out: str = "mean") -> DataFrame:
    """Mean by dimension of the vectors of each key, as an array."""
    flat = df.select(*keys, F.posexplode(vector).alias("_dim", "_x")).groupBy(*keys, "_dim").agg(F.avg("_x").alias("_x"))
    pairs = F.array_sort(F.collect_list(F.struct("_dim", "_x")))
    return flat.groupBy(*keys).agg(F.transform(pairs, lambda p: p["_x"]).alias(out)) if keys else flat.agg(F.transform(pairs, lambda p: p["_x"]).alias(out))
