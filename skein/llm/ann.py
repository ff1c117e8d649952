"""Approximate nearest neighbours over balanced posting lists (after Chen et al., 2021).

Centroids come from halving a bounded sample again and again at the median, so lists are even. A graph over the
centroids, searched in memory, finds the lists of a vector: those whose distance is within a ratio of the nearest
one's. Vectors near a boundary go to several lists; the ratio of a query's lists is set on the sample, so that its own
nearest neighbours are found with TARGET. Lists are packed into shards of bounded size (a large list into several),
each query goes once to every shard that holds some of its lists, where only these lists' rows are measured, in double
precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import dimension, matrix, usable

#: Bounds of the fit: sampled vectors, their bytes, lists. Beyond LIST_ROWS * MAX_LISTS rows (2 million) lists grow longer.
SAMPLE, SAMPLE_BYTES, MAX_LISTS = 131_072, 128 << 20, 16_384
#: Rows of a list aimed at, of a shard, and queries of a shard's block.
LIST_ROWS, SHARD_ROWS, BLOCK_QUERIES = 128, 8192, 4096
#: Lists that a vector may be in, and how much farther than the nearest such a list may be.
REPLICAS, SPREAD = 4, 1.15
#: Neighbours of a node in the graph, random links beside them, and width of the search for a vector's own lists.
NEIGHBOURS, LONG_LINKS, WIDTH = 24, 8, 32
#: Share of the sample's nearest neighbours that the ratio has to reach, and queries it is measured with.
TARGET, CALIBRATION = 0.98, 512


def halved(x: np.ndarray, ids: np.ndarray, lists: int, rng: np.random.Generator) -> list[np.ndarray]:
    """`ids` in `lists` groups of equal size (but for rounding): 2-means, cut where both sides get their share."""
    if lists <= 1 or len(ids) < 2:
        return [ids]
    own, left = x[ids], lists // 2
    cut = min(len(ids) - 1, max(1, round(len(ids) * left / lists)))
    a, b = own[rng.choice(len(ids), 2, replace=False)]
    for _ in range(6):
        order = np.argsort(own @ (b - a), kind="stable")
        a, b = own[order[:cut]].mean(axis=0), own[order[cut:]].mean(axis=0)
    return halved(x, ids[order[:cut]], left, rng) + halved(x, ids[order[cut:]], lists - left, rng)


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    entry: np.ndarray
    ratio: float
    width: int

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the `width` nearest centroids that the graph leads to, and squared distances, nearest first."""
        k, n = len(self.centroids), len(x)
        width = min(width, k)
        norm = (self.centroids**2).sum(axis=1)
        far = lambda rows, at: norm[at] - 2 * np.einsum("nd,nmd->nm", x[rows], self.centroids[at])
        every = np.arange(n)
        ids = np.full((n, width), -1)
        dist = np.full((n, width), np.inf)
        done = np.zeros((n, width), bool)
        seen = np.zeros((n, k), bool)
        new, rows = np.broadcast_to(self.entry, (n, len(self.entry))), every
        while len(rows):
            fresh = ~seen[rows[:, None], new]
            seen[rows[:, None], new] = True
            d = np.where(fresh, far(rows, new), np.inf)
            both, ways = np.concatenate([ids[rows], new], axis=1), np.concatenate([dist[rows], d], axis=1)
            flags = np.concatenate([done[rows], np.zeros(new.shape, bool)], axis=1)
            best = np.argsort(ways, axis=1, kind="stable")[:, :width]
            ids[rows], dist[rows], done[rows] = (np.take_along_axis(y, best, 1) for y in (both, ways, flags))
            open_ = ~done[rows] & np.isfinite(dist[rows])
            todo = open_.any(axis=1)
            rows, at = rows[todo], open_[todo].argmax(axis=1)
            done[rows, at] = True
            new = self.graph[ids[rows, at]]
        return ids, np.maximum(dist + (x**2).sum(axis=1, keepdims=True), 0)

    def lists(self, x: np.ndarray, ratio: float, width: int, most: int, sizes: np.ndarray | None = None, rows: int = 0) -> Iterator[np.ndarray]:
        """Lists of each row: those within `ratio` times the least distance, nearest first, and as many as hold `rows` rows by `sizes`."""
        for low in range(0, len(x), 512):
            ids, dist = self.search(x[low : low + 512], width)
            for own, d in zip(ids, dist, strict=True):
                n = min(most, int((d <= ratio**2 * d[0] + 1e-12).sum()))
                if sizes is not None:
                    n = max(n, min(len(own), int(np.searchsorted(np.cumsum(sizes[own]), rows)) + 1))
                yield own[:n]


def fitted(sample: np.ndarray, n: int, k: int) -> Index:
    """An index for n vectors whose queries ask for k neighbours."""
    rng = np.random.default_rng(17)
    lists = max(1, min(MAX_LISTS, math.ceil(n / LIST_ROWS), len(sample) // 8))
    groups = [g for g in halved(sample, np.arange(len(sample)), lists, rng) if len(g)]
    centroids = np.stack([sample[g].mean(axis=0) for g in groups])
    c, norm, near = len(centroids), (centroids**2).sum(axis=1), []
    for low in range(0, c, 256):
        d = norm[None] - 2 * centroids[low : low + 256] @ centroids.T
        near.append(np.argsort(d, axis=1, kind="stable")[:, : min(c, NEIGHBOURS + 1)])
    graph = np.sort(np.concatenate([np.concatenate(near), rng.integers(0, c, (c, LONG_LINKS))], axis=1), axis=1)
    again = np.zeros(graph.shape, bool)
    again[:, 1:] = graph[:, 1:] == graph[:, :-1]
    # a second link to the same node becomes one to the node itself, which the search has seen when it follows links
    graph = np.where(again, np.arange(c)[:, None], graph)
    index = Index(centroids, graph, np.unique(rng.integers(0, c, 16)), 1.0, min(c, WIDTH))
    # where do the sample's own neighbours lie?
    ask = rng.choice(len(sample), min(CALIBRATION, len(sample)), replace=False)
    size, want = (sample**2).sum(axis=1), []
    for low in range(0, len(ask), 64):
        own = ask[low : low + 64]
        d = size[None] - 2 * sample[own] @ sample.T
        d[np.arange(len(own)), own] = np.inf
        take = min(k, len(sample) - 1)
        want.append(np.argpartition(d, max(0, take - 1), axis=1)[:, :take])
    want = np.concatenate(want)
    met = np.unique(want)
    own = dict(zip(met.tolist(), index.lists(sample[met], SPREAD, WIDTH, REPLICAS), strict=True))
    ids, dist = index.search(sample[ask], c)
    need = []
    for row in range(len(ask)):
        place = np.full(c, c - 1)
        place[ids[row][ids[row] >= 0]] = np.flatnonzero(ids[row] >= 0)
        need += [math.sqrt(dist[row, place[own[y]].min()] / max(dist[row, 0], 1e-12)) for y in want[row].tolist()]
    if need:
        index.ratio = float(np.quantile(need, TARGET)) + 1e-6
        within = (dist <= index.ratio**2 * dist[:, :1]).sum(axis=1)
        index.width = int(min(c, max(WIDTH, within.max() + 8)))
    return index


def probed_share(index: Index, asked: np.ndarray) -> float:
    """Mean share of all lists that the queries `asked` go to."""
    return float(np.mean([len(x) for x in index.lists(asked, index.ratio, index.width, index.width)])) / len(index.centroids)


def _copy_rank(x: np.ndarray, order_id: np.ndarray) -> np.ndarray:
    """0 for the least id among equal rows, 1 for the next, and so on."""
    key = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, same = np.unique(key, return_inverse=True)
    order = np.lexsort((order_id, same))
    first = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return out


def block_neighbours(base: pa.Table, asked: pa.Table, dim: int, k: int) -> pa.Table:
    """base: rid, id, list, embedding; asked: rid, id, lists, embedding. The k nearest rows in the lists of each query.

    Of equal rows only the k + 1 of the least ids can be among a query's k nearest others; the rest isn't measured.
    """
    kinds = {"query_rid": pa.int64(), "query_id": pa.int64(), "rid": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    none = pa.table({c: pa.array([], t) for c, t in kinds.items()})
    if not base.num_rows or not asked.num_rows:
        return none
    rid, lists = base.column("rid").to_numpy(), base.column("list").to_numpy()
    _, one, back = np.unique(rid, return_index=True, return_inverse=True)
    x, ids, rid = matrix(base.column("embedding").combine_chunks().take(pa.array(one)), dim), base.column("id").combine_chunks().take(pa.array(one)), rid[one]
    order_id = ids.fill_null(2**63 - 1).to_numpy()
    stays = _copy_rank(x, order_id)[back] <= k
    back, lists = back[stays], lists[stays]
    by_list = np.argsort(lists, kind="stable")
    names, low = np.unique(lists[by_list], return_index=True)
    members = dict(zip(names.tolist(), np.split(back[by_list], low[1:]), strict=True))
    norm, q, q_rid = (x**2).sum(axis=1), matrix(asked.column("embedding"), dim), asked.column("rid").to_numpy()
    q_norm = (q**2).sum(axis=1)
    slack = 1e-9 * (norm.max() + q_norm)
    wanted = asked.column("lists").combine_chunks()
    who_asks = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
    asked_lists = wanted.flatten().to_numpy()
    by_list = np.argsort(asked_lists, kind="stable")
    names, low = np.unique(asked_lists[by_list], return_index=True)
    who, what = [], []
    for name, queries in zip(names.tolist(), np.split(who_asks[by_list], low[1:]), strict=True):
        rows = members.get(name)
        if rows is None:
            continue
        for some in np.array_split(queries, math.ceil(len(queries) * len(rows) / (1 << 21))):
            d = norm[rows][None] - 2 * q[some] @ x[rows].T + q_norm[some][:, None]
            d[rid[rows][None] == q_rid[some][:, None]] = np.inf
            take = min(k, d.shape[1])
            edge = np.partition(d, take - 1, axis=1)[:, take - 1]
            i, j = np.nonzero((d <= (edge + slack[some])[:, None]) & np.isfinite(d))
            who.append(some[i])
            what.append(rows[j])
    if not who:
        return none
    pairs = np.unique(np.concatenate(who) * np.int64(len(x)) + np.concatenate(what))
    who, what = pairs // len(x), pairs % len(x)
    exact = np.concatenate([np.sqrt(((x[what[a : a + 65536]] - q[who[a : a + 65536]]) ** 2).sum(axis=1)) for a in range(0, len(who), 65536)])
    order = np.lexsort((order_id[what], exact, who))
    first = np.flatnonzero(np.concatenate([[True], who[order][1:] != who[order][:-1]]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    best = order[rank < k]
    who, what, exact = who[best], what[best], exact[best]
    query_id = asked.column("id").combine_chunks()
    columns = [pa.array(q_rid[who]), query_id.take(pa.array(who)), pa.array(rid[what]), ids.take(pa.array(what)), pa.array(exact)]
    return pa.table(dict(zip(kinds, columns, strict=True)))


def sampled(good: DataFrame, n: int, dim: int) -> np.ndarray:
    """About SAMPLE vectors of at most SAMPLE_BYTES, in double precision: those whose hash is below a share of all hashes.

    So each task returns its own share, and none gathers those of all others. good: rid, embedding, n rows.
    """
    share = min(SAMPLE, SAMPLE_BYTES // (8 * dim)) / n
    drawn = good if share >= 1 else good.filter(F.shiftrightunsigned(F.xxhash64("rid"), 1) < max(1, int(share * (1 << 63))))
    got = drawn.select("rid", "embedding").toArrow().sort_by("rid")
    return matrix(got.column("embedding"), dim)


def neighbours(rows: DataFrame, every: int = 100, k: int = 10, dim: int | None = None) -> DataFrame:
    """rows: vec_id long, embedding (array of numbers); other columns are not read. Queries: vec_id divisible by `every`.

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance in double precision): the k nearest rows found
    other than the query's own row, ties to the smaller vec_id (null last), all if fewer. dim: the vectors' length;
    without it, the one that most usable vectors have (of ties the greater). Vectors that are null, empty, zero, not
    finite or of another length take no part. A repeated row is a candidate of its own, and asks on its own. An empty
    table gives an empty result.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "embedding")
    dim = dim or dimension(rows)
    good = rows.filter(usable() & (F.size("embedding") == max(1, dim))).withColumn("rid", F.monotonically_increasing_id())
    good = written(good, "ann-vectors")
    n = good.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fitted(sampled(good, n, dim), n, k)
    shared = spark.sparkContext.broadcast(index)
    lengths = np.zeros(0, np.int64)
    kind = dict(rows.dtypes)["embedding"]

    def listed(batches: Iterator[pa.RecordBatch], asking: bool) -> Iterator[pa.RecordBatch]:
        index = shared.value
        how = (index.ratio, index.width, index.width, lengths, REPLICAS * (k + 1)) if asking else (SPREAD, WIDTH, REPLICAS)
        for batch in batches:
            lists = [x.tolist() for x in index.lists(matrix(batch.column(2), dim), *how)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(lists, pa.list_(pa.int32()))], names=["rid", "id", "embedding", "lists"])

    schema = f"rid long, id long, embedding {kind}, lists array<int>"
    parts_ = good.select("rid", F.col("vec_id").alias("id"), "embedding")
    placed = written(parts_.mapInArrow(lambda b: listed(b, False), schema), "ann-placed")
    sizes = placed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()
    plan, shard, room, lengths = [], 0, SHARD_ROWS, np.zeros(len(index.centroids), np.int64)
    for name, size in sorted((r["list"], r["n"]) for r in sizes):
        lengths[name] = size
        if size > room:
            shard, room = shard + 1, SHARD_ROWS
        blocks = math.ceil(size / SHARD_ROWS)
        plan.append((name, shard, blocks))
        shard, room = (shard + blocks - 1, SHARD_ROWS if blocks > 1 else room - size)
        if blocks > 1:
            shard += 1
    where = F.broadcast(spark.createDataFrame(plan, "list int, shard int, blocks int"))
    asked = parts_.filter(F.col("id") % every == 0).mapInArrow(lambda b: listed(b, True), schema)
    asked = asked.select("rid", "id", "embedding", F.explode("lists").alias("list")).join(where, "list")
    asked = asked.withColumn("shard", F.explode(F.expr("sequence(shard, shard + blocks - 1)")))
    asked = asked.groupBy("rid", "shard").agg(F.first("id").alias("id"), F.first("embedding").alias("embedding"), F.collect_list("list").alias("lists"))
    asked = written(asked, "ann-asked")
    crowds = asked.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("crowd"))
    asked = asked.join(crowds, "shard").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("crowd")))
    base = placed.select("rid", "id", "embedding", F.explode("lists").alias("list")).join(where, "list")
    base = base.withColumn("shard", (F.col("shard") + F.pmod(F.xxhash64("rid"), F.col("blocks"))).cast("int")).join(crowds, "shard")
    base = base.withColumn("block", F.explode(F.expr("sequence(0L, crowd - 1L)"))).select("shard", "block", "rid", "id", "list", "embedding")
    asked = asked.select("shard", "block", "rid", "id", "lists", "embedding")
    got = base.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(lambda a, b: block_neighbours(a, b, dim, k), "query_rid long, query_id long, rid long, vec_id long, score double")
    got = got.groupBy("query_rid", "rid").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_rid").orderBy("score", F.col("vec_id").asc_nulls_last(), "rid"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
