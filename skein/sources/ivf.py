"""Chunk vectors stored by the list of their nearest centroid, so that a query opens the files of its own lists only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from skein.scratch import written

#: Centroids that go to every task at once (more are taken in blocks of so many numbers), and rows of a file.
BLOCK_NUMBERS, FILE_ROWS = 1 << 22, 1 << 17
#: Rows and queries of a block, which meet in one task, and those compared at once.
BLOCK_ROWS, BLOCK_QUERIES, TILE, TILE_QUERIES = 1 << 14, 1 << 12, 1 << 11, 1 << 5


def _blocks(centroids: DataFrame, dim: int) -> list[DataFrame]:
    """The centroids in blocks of a bounded size, dealt by their number."""
    blocks = max(1, -(-centroids.count() * dim // BLOCK_NUMBERS))
    return [centroids.filter(F.pmod("cluster_id", F.lit(blocks)) == k) for k in range(blocks)]


def nearest_lists(rows: DataFrame, centroids: DataFrame, n: int = 1, vector: str = "embedding") -> DataFrame:
    """`rows` with `lists`: (score, cluster_id) of the n nearest centroids by inner product, best first, ties to the lower number.

    centroids: cluster_id, embedding. They pass by the rows in blocks of a bounded size; a block is a product of matrices
    for each batch, and rows without a vector get an empty list.
    """
    dim = centroids.select(F.max(F.size("embedding"))).first()[0] or 1
    out = rows.withColumn("lists", F.array().cast("array<struct<score:double,cluster_id:int>>"))
    at = out.columns.index(vector)
    for block in _blocks(centroids.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("embedding")), dim):
        table = block.orderBy("cluster_id").toArrow()
        if not len(table):
            continue
        ids, matrix = table.column(0).to_numpy(), np.stack([np.array(v) for v in table.column(1).to_pylist()])
        sent = rows.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            for batch in batches:
                found = batch.column(batch.num_columns - 1).to_pylist()
                whole = [k for k, ok in enumerate(batch.column(at).is_valid().to_pylist()) if ok]
                if whole:
                    scores = np.array([batch.column(at)[k].as_py() for k in whole], float) @ matrix.T
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
                    for k, score, own in zip(whole, scores, best, strict=True):
                        merged = found[k] + [{"score": float(score[j]), "cluster_id": int(ids[j])} for j in own]
                        found[k] = sorted(merged, key=lambda x: (-x["score"], x["cluster_id"]))[:n]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, batch.schema.field("lists").type)], schema=batch.schema)

        out = out.mapInArrow(run, out.schema)
    return out


def assigned(rows: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """`rows` with the cluster_id of the nearest centroid, null without a vector."""
    return nearest_lists(rows, centroids, 1, vector).withColumn("cluster_id", F.try_element_at("lists", F.lit(1))["cluster_id"]).drop("lists")


def store(chunks: DataFrame, centroids: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Writes chunks (with cluster_id) as `path/vectors`, a folder a list, and the centroids beside them.

    A long list is dealt to as many tasks as it needs files, so no task holds all of one.
    """
    sizes = chunks.groupBy("cluster_id").agg(F.ceil(F.count("*") / file_rows).alias("_files"))
    dealt = chunks.join(sizes, "cluster_id").withColumn("_file", F.pmod(F.xxhash64(*chunks.columns), F.col("_files")))
    dealt.repartition("cluster_id", "_file").drop("_file", "_files").write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("cluster_id").parquet(f"{path}/vectors")
    centroids.select("cluster_id", "embedding").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def probed(spark: SparkSession, path: str, queries: DataFrame, probes: int = 20, k: int = 10, vector: str = "embedding", columns: list[str] | None = None) -> DataFrame:
    """The k best rows among each query's nearest lists: cluster_id, the stored columns (or those named), query_id, score, rank; ties by `id`.

    queries: query_id, _q. The chosen lists are a small table of its own; joined on the folder's column, it prunes the scan
    to their files (dynamic partition pruning). A list's rows and the queries that read it are dealt in blocks of bounded
    sizes, and each pair of blocks gives the k best of its rows for each of its queries, so no pair becomes a row.
    """
    near = nearest_lists(queries, spark.read.parquet(f"{path}/centroids"), probes, "_q")
    near = written(near.select("query_id", "_q", F.explode("lists").alias("l")).select("query_id", "_q", "l.cluster_id", F.col("l.score").alias("_near")), "ivf-probes")
    asked = near.groupBy("cluster_id").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("_qn"))
    stored = spark.read.parquet(f"{path}/vectors")
    sizes = written(near_rows(stored, asked).groupBy("cluster_id", "_qn").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_rn")), "ivf-blocks")
    kept = [c for c in stored.columns if c != "cluster_id" and (columns is None or c in columns or c == "id")]
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = near_rows(stored, sizes).select("cluster_id", *kept, F.col(vector).cast("array<double>").alias("_x"), F.pmod(F.xxhash64("id", vector), F.col("_rn")).alias("_r"), blocks("_qn").alias("_b"))
    few = near.join(sizes, "cluster_id").withColumn("_b", F.pmod(F.xxhash64("query_id", "_q"), F.col("_qn"))).select("cluster_id", "query_id", F.col("_q").cast("array<double>").alias("_q"), "_b", blocks("_rn").alias("_r"))
    kinds, names = dict(rows.dtypes) | dict(few.dtypes), ["cluster_id", *kept, "query_id"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    at = ["cluster_id", "_r", "_b"]
    best = rows.groupBy(*at).cogroup(few.groupBy(*at)).applyInArrow(lambda x, q: _best(x, q, k, arrow), schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k)


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length; one that is null or holds a null is left out."""
    v = vectors.combine_chunks()
    size, flat = pc.list_value_length(v).fill_null(-1).to_numpy().copy(), v.flatten()
    start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])[:-1]
    if flat.null_count:
        gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        size[(size > 0) & (gaps[start + np.maximum(size, 0)] > gaps[start])] = -1
    numbers = flat.to_numpy(zero_copy_only=False)
    return {int(n): (own := np.flatnonzero(size == n), numbers[start[own][:, None] + np.arange(n)]) for n in np.unique(size[size >= 0])}


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all pairs, each summed in the order of its dimensions (as `dot` does), so that ties and ranks agree with it."""
    out = np.zeros((len(q), len(x)))
    for at in range(0, len(x), TILE):
        own = np.ascontiguousarray(x[at : at + TILE].T)
        part, product = np.zeros((len(q), own.shape[1])), np.empty((len(q), own.shape[1]))
        for d in range(len(own)):
            part += np.multiply(q[:, d, None], own[d], out=product)
        out[:, at : at + TILE] = part
    return out


def _best(rows: pa.Table, queries: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The k best rows of a block for each query of another; scores that are not numbers stand as in Spark's order: NaN first, null last."""
    if not len(rows) or not len(queries):
        return schema.empty_table()
    rows = rows.take(pc.sort_indices(rows, [("id", "ascending")], null_placement="at_start"))
    x, q, top = _by_length(rows.column("_x")), _by_length(queries.column("_q")), np.finfo(float).max
    n, parts = min(k, len(rows)), []
    none = np.setdiff1d(np.arange(len(queries)), np.concatenate([np.zeros(0, int), *(own for own, _ in q.values())]))
    for size, (asked, numbers) in [*q.items(), (-1, (none, np.zeros((len(none), 0))))]:
        own, matrix = x.get(size, (np.zeros(0, int), np.zeros((0, max(size, 0)))))
        for a in range(0, len(asked), TILE_QUERIES):
            part = asked[a : a + TILE_QUERIES]
            score, key = np.full((len(part), len(rows)), np.nan), np.full((len(part), len(rows)), np.inf)
            with np.errstate(all="ignore"):
                score[:, own] = _products(numbers[a : a + TILE_QUERIES], matrix)
            key[:, own] = np.where(np.isnan(score[:, own]), -np.inf, -np.clip(score[:, own], -top, top))
            at, row = np.nonzero(key <= np.partition(key, n - 1, axis=1)[:, n - 1 :][:, :1])
            order = np.lexsort((row, key[at, row], at))
            at, row = at[order], row[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < n
            at, row = at[first], row[first]
            parts.append((part[at], row, score[at, row], ~np.isin(row, own)))
    at, row, score, gone = (np.concatenate(c) for c in zip(*parts, strict=True))
    taken = rows.take(pa.array(row))
    cols = [taken.column(c) for c in schema.names[:-2]] + [queries.column("query_id").take(pa.array(at)), pa.array(score, mask=gone, from_pandas=False)]
    return pa.Table.from_arrays(cols, names=schema.names).cast(schema)


def near_rows(vectors: DataFrame, lists: DataFrame, most: int = 1 << 16) -> DataFrame:
    """Stored rows of the lists in `lists` (cluster_id, once each, and what else a list has; few, which is checked)."""
    few = lists.count() <= most
    lists = lists.filter(F.col("cluster_id") >= -(1 << 31))  # a condition on this side is what lets Spark prune the other
    return vectors.join(F.broadcast(lists) if few else lists, "cluster_id")
