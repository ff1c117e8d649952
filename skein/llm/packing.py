"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt at random to shards of bounded size. Each shard is evolved on several islands from different seeds;
between the rounds an island gets its neighbour's elite, until a shard needs no more bins than its total does. A crossover injects well-filled bins of one parent whole into
the other, drops the bins that hold an injected piece already, and best-fits the pieces so displaced. Bins that stay
poorly filled are dealt to new shards and packed again.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, written
from .tokens import encoder
from .words import chunks

CAPACITY = 4096
END_ID = 1
#: Pieces of a shard, islands it is evolved on, rounds (between two of them elites migrate), and of a round on an island:
#: packings kept, generations, and packings that migrate.
SHARD_PIECES, ISLANDS, ROUNDS, POPULATION, GENERATIONS, ELITE = 8192, 3, 4, 6, 12, 2
#: Bins filled below this share go to the next level; levels at most.
WELL_FILLED, LEVELS = 0.98, 3


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole texts (null: empty) with END_ID after each, cut at the capacity only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            for rows, body, at in chunks(batch.column(1)):
                ids, first = words.chunk(body, at)
                doc, piece, start, length, crc = [], [], [], [], []
                for k in range(len(at) - 1):
                    own = np.append(ids[first[k] : first[k + 1]], np.uint32(END_ID)).astype("<u4")
                    for p, low in enumerate(range(0, len(own), capacity)):
                        part = own[low : low + capacity]
                        doc.append(k)
                        piece.append(p)
                        start.append(low)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows].take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return text.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(bins: np.ndarray, sizes: np.ndarray, items: np.ndarray, capacity: int) -> np.ndarray:
    """Places `items`, in order, each into the fullest bin with room, else a new one. bins: of each item, -1 without."""
    bins = bins.copy()
    used = bins >= 0
    n = int(bins.max()) + 1 if used.any() else 0
    room = capacity - np.bincount(bins[used], sizes[used], n).astype(np.int64)
    free = sorted(zip(room[room > 0].tolist(), np.flatnonzero(room > 0).tolist(), strict=True))
    for i in items.tolist():
        s = int(sizes[i])
        k = bisect.bisect_left(free, (s, -1))
        if k < len(free):
            left, b = free.pop(k)
        else:
            left, b = capacity, n
            n += 1
        bins[i] = b
        if left > s:
            bisect.insort(free, (left - s, b))
    return bins


def renumbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins, then more uneven filling (which leaves whole bins to empty); less is better."""
    load = np.bincount(bins, sizes)
    return len(load), -float(((load / capacity) ** 2).mean()) if len(load) else 0.0


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Bins of `b`, the fuller the likelier, injected into `a`."""
    load = np.bincount(b, sizes)
    chosen = rng.random(len(load)) < 0.4 * (load / capacity) ** 4
    injected = chosen[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[injected]] = True
    child = np.where(injected, a.max() + 1 + b, np.where(broken[a], -1, a))
    lost = np.flatnonzero(child < 0)
    child = np.where(child >= 0, np.unique(child, return_inverse=True)[1] - int(len(lost) > 0), -1)
    return renumbered(best_fit(child, sizes, lost[np.argsort(-sizes[lost], kind="stable")], capacity))


def evolved(sizes: np.ndarray, population: list[np.ndarray], seed: tuple[int, ...], capacity: int, stats: list[int] | None = None) -> list[np.ndarray]:
    """`population` filled up to POPULATION and evolved, best first; ends once the bins are as few as the total allows.

    The first packing is best fit by falling size; others bend the sizes that order the pieces. stats: crossovers run.
    """
    rng, bound = np.random.default_rng(seed), math.ceil(sizes.sum() / capacity)
    score = lambda x: fitness(x, sizes, capacity)
    while len(population) < POPULATION:
        if any(score(x)[0] <= bound for x in population):
            break
        bent = sizes * (1 + (0.15 * rng.random(len(sizes)) if population else 0))
        population.append(renumbered(best_fit(np.full(len(sizes), -1), sizes, np.argsort(-bent, kind="stable"), capacity)))
    population.sort(key=score)
    for _ in range(GENERATIONS):
        if score(population[0])[0] <= bound or len(population) < 2:
            break
        i, j = sorted(rng.choice(len(population), 2, replace=False))
        children = [crossover(population[i], population[j], sizes, capacity, rng), crossover(population[j], population[i], sizes, capacity, rng)]
        if stats is not None:
            stats[0] += 2
        # equal packings would fill the island with one another's copies
        distinct = {score(x): x for x in [*children, *reversed(population)]}
        population = sorted(distinct.values(), key=score)[:POPULATION]
    return population


def _round(rows: Iterator[pa.RecordBatch], capacity: int, k: int) -> Iterator[pa.RecordBatch]:
    """Round k. Rows: shard, island, sizes, elites (arrays of bins). Gives shard, island, n_bins, elites; the last round: the best one."""
    for batch in rows:
        for shard, island, sizes, elites in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            sizes = np.array(sizes, np.int64)
            best = evolved(sizes, [np.array(x, np.int32) for x in elites], (shard, island, k), capacity)[: 1 if k == ROUNDS - 1 else ELITE]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([island], pa.int32()), pa.array([fitness(best[0], sizes, capacity)[0]], pa.int32()), pa.array([[x.tolist() for x in best]], pa.list_(pa.list_(pa.int32())))],
                names=["shard", "island", "n_bins", "elites"],
            )


def _packed_once(pieces: DataFrame, n: int, capacity: int) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32) with shard, bin, offset, load."""
    shards = max(1, math.ceil(n / SHARD_PIECES))
    cols = ["length", "doc_id", "piece", "start", "ids_crc32"]
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("long")
    dealt = pieces.withColumn("shard", shard).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(*cols)), asc=False).alias("items"))
    dealt = written(dealt, "pack-shards")
    width = min(parts(pieces.sparkSession), shards * ISLANDS)
    schema = "shard long, island int, n_bins int, elites array<array<int>>"
    each = dealt.select("shard", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"), F.col("items.length").alias("sizes"))
    now = each.repartition(width, "shard", "island").select("shard", "island", "sizes", F.array().cast("array<array<int>>").alias("elites"))
    for k in range(ROUNDS):
        done = written(now.mapInArrow(lambda x, k=k: _round(x, capacity, k), schema), "pack-elites")
        # shards that have a packing into as few bins as their total allows rest
        least = done.groupBy("shard").agg(F.min("n_bins").alias("n_bins"))
        goal = dealt.select("shard", F.ceil(F.expr("aggregate(items.length, 0L, (a, b) -> a + b)") / capacity).alias("goal"))
        open_ = least.join(goal, "shard").filter("n_bins > goal").select("shard")
        rest = done.join(open_, "shard", "left_anti") if k < ROUNDS - 1 else done
        best = rest.select("shard", "island", "n_bins", F.col("elites")[0].alias("bins"))
        found = best if k == 0 else found.unionByName(best)
        if k == ROUNDS - 1 or open_.isEmpty():
            break
        guests = done.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elites").alias("guests"))
        again = each.join(open_, "shard", "left_semi").join(done, ["shard", "island"]).join(guests, ["shard", "island"])
        now = again.select("shard", "island", "sizes", F.concat("elites", "guests").alias("elites"))
    best = found.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", "island")).alias("bins"))
    both = dealt.join(best, "shard").select("shard", F.posexplode(F.arrays_zip("items", "bins")))
    rows = both.select("shard", F.col("col.bins").cast("long").alias("bin"), "pos", "col.items.*")
    bin_ = Window.partitionBy("shard", "bin")
    before = F.sum("length").over(bin_.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return rows.withColumn("offset", before).withColumn("load", F.sum("length").over(bin_)).drop("pos")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces: doc_id, piece, start, length (1 to capacity), ids_crc32. Adds sequence_id and offset.

    Every row gets a place: within a sequence the pieces stand without gaps from 0 and never exceed the capacity. Ids
    may be null or repeated; each row is a piece of its own. An empty table gives an empty result.
    """
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = pieces.filter(F.col("length") == capacity).withColumn("offset", F.lit(0).cast("long"))
    done = [full.withColumn("sequence_id", F.monotonically_increasing_id() * (LEVELS + 1)).select(*cols)]
    rest = pieces.filter(F.col("length") < capacity)
    for level in range(1, LEVELS + 1):
        n = rest.count()
        if not n:
            break
        now = written(_packed_once(rest, n, capacity).withColumn("sequence_id", (F.col("shard") * (SHARD_PIECES * 1024) + F.col("bin")) * (LEVELS + 1) + level), "packed")
        last = level == LEVELS or n <= SHARD_PIECES
        good = now if last else now.filter(F.col("load") >= WELL_FILLED * capacity)
        done.append(good.select(*cols))
        if last:
            break
        rest = now.filter(F.col("load") < WELL_FILLED * capacity)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """docs: doc_id, text; other columns are not read. One row a piece, as in `pack`.

    A null or empty text is one piece of the end id alone. Texts of any length are cut at the capacity only. Ids may be
    null or repeated: each row is a document of its own. An empty table gives an empty result.
    """
    return pack(written(tokenised(docs, tokenizer, capacity), "pieces"), capacity)
