"""Spherical k-means of many corpora at once, with no corpus in one task (K2 to K4).

Vectors lie on a grid of integers, so that inner products, sums and costs are exact in double precision: results depend on
neither the number of partitions nor the order of rows. A round sends the centres to all tasks, which return the count and the sum of
each cluster's vectors; seeds are drawn in a few rounds by cost (k-means||, Bahmani et al., 2012).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.functions.vectors import normalised
from skein.scratch import forget, written

#: Steps of the grid in a unit; bits that costs lose, so that their sums fit.
GRID, COST_BITS = 1 << 20, 11
#: Rounds of updates at most; rounds of seeding, and seeds drawn in one for each cluster.
ROUNDS, SEEDINGS, DRAWN = 20, 4, 2
#: Numbers of all centres that are with the driver at once; more corpora are done in waves.
WAVE_NUMBERS = 1 << 20

Centres = dict[object, np.ndarray]


def gridded(rows: DataFrame) -> DataFrame:
    """corpus, id, h (a hash of both), x: the unit vector in steps of the grid. rows: corpus, id, embedding."""
    unit = normalised(F.col("embedding").cast("array<double>"))
    return rows.select("corpus", "id", F.xxhash64("corpus", "id").alias("h"), F.transform(unit, lambda v: F.rint(v * GRID).cast("int")).alias("x"))


def _drawn(h: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each hash, another one for each salt (splitmix64)."""
    z = h.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


def _scan(table: DataFrame, centres: Centres, emit: Callable, schema: str) -> DataFrame:
    """What `emit(corpus, ids, h, x, scores)` gives for the rows of each corpus in a batch; scores: rows x centres, exact."""
    sent = table.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            own = np.asarray(names.indices)
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1))
            h = batch.column(2).to_numpy()
            for k, name in enumerate(names.dictionary.to_pylist()):
                c = known.get(name)
                if c is not None:
                    at = np.flatnonzero(own == k)
                    yield from emit(name, batch.column(1).take(pa.array(at)), h[at], x[at], x[at] @ c.T)

    return table.mapInArrow(run, schema)


def _costs(scores: np.ndarray) -> np.ndarray:
    return np.maximum(0, GRID * GRID - scores.max(axis=1)).astype(np.int64) >> COST_BITS


def _sums(table: DataFrame, centres: Centres, kind: str) -> dict[object, dict[int, tuple[int, np.ndarray]]]:
    """Count and sum of the vectors nearest each centre: by corpus and number of the centre, those that have any."""
    name_type = to_arrow_type(table.schema["corpus"].dataType)

    def emit(name, ids, h, x, scores):
        own = scores.argmax(axis=1)
        for j in np.unique(own):
            part = x[own == j].sum(axis=0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name], name_type), pa.array([int(j)], pa.int32()), pa.array([int((own == j).sum())]), pa.array([part.tolist()])], names=["corpus", "cluster", "n", "sums"])

    def merged(t: pa.Table) -> pa.Table:
        total = np.array(t["sums"].to_pylist(), np.int64).sum(axis=0)
        return pa.table({"corpus": t["corpus"].slice(0, 1), "cluster": t["cluster"].slice(0, 1), "n": pa.array([int(np.sum(t["n"].to_numpy()))]), "sums": pa.array([total.tolist()])})

    schema = f"corpus {kind}, cluster int, n long, sums array<long>"
    out: dict = {}
    for r in _scan(table, centres, emit, schema).groupBy("corpus", "cluster").applyInArrow(merged, schema).toLocalIterator():
        out.setdefault(r.corpus, {})[r.cluster] = (r.n, np.array(r.sums, np.int64))
    return out


def _on_grid(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return np.rint(v / max(np.sqrt((v * v).sum()), 1e-300) * GRID)


def _weighted_seeds(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the candidates by k-means++ with weights, then some rounds among the candidates alone."""
    rng, chosen = np.random.default_rng(seed), []
    far = np.full(len(x), float(GRID) * GRID * 2)
    while len(chosen) < k:
        mass = weight * far
        if mass.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(x), p=mass / mass.sum())))
        far = np.minimum(far, np.maximum(0, GRID * GRID - x @ x[chosen[-1]]))
    c = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        new = np.array([_on_grid((x[own == j] * weight[own == j, None]).sum(axis=0)) if (own == j).any() else c[j] for j in range(len(c))])
        if (new == c).all():
            break
        c = new
    return c


def _seeds(table: DataFrame, sizes: dict[object, int], kind: str, seed: int) -> Centres:
    """Candidates drawn in rounds by their cost, then weighted by the vectors nearest them, then chosen from."""
    row = f"corpus {kind}, h long, x array<int>"
    name_type = to_arrow_type(table.schema["corpus"].dataType)
    first = table.groupBy("corpus").agg(F.min_by("x", "h").alias("x"))
    centres: Centres = {r.corpus: np.array([r.x], np.float64) for r in first.toLocalIterator() if r.corpus in sizes}

    def cost(name, ids, h, x, scores):
        yield pa.RecordBatch.from_arrays([pa.array([name], name_type), pa.array([int(_costs(scores).sum())])], names=["corpus", "cost"])

    for turn in range(SEEDINGS):
        total = {r.corpus: r.cost for r in _scan(table, centres, cost, f"corpus {kind}, cost long").groupBy("corpus").agg(F.sum("cost").alias("cost")).toLocalIterator()}

        def draw(name, ids, h, x, scores, total=total, turn=turn):
            at = np.flatnonzero(_drawn(h, seed + turn) * total[name] < DRAWN * sizes[name] * _costs(scores))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), name_type), pa.array(h[at]), pa.array(x[at].astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["corpus", "h", "x"])

        found: dict = {}
        for r in _scan(table, centres, draw, row).toLocalIterator():
            found.setdefault(r.corpus, []).append((r.h, r.x))
        for name, rows in found.items():
            centres[name] = np.vstack([centres[name], np.array([x for _, x in sorted(rows)], np.float64)])
    counts = _sums(table, centres, kind)
    out = {}
    for n, (name, x) in enumerate(sorted(centres.items(), key=lambda i: str(i[0]))):
        weight = np.array([counts.get(name, {}).get(j, (0,))[0] for j in range(len(x))], float)
        out[name] = _weighted_seeds(x, weight, sizes[name], seed + n)
    return out


def _repaired(table: DataFrame, centres: Centres, empty: dict[object, list[int]], kind: str) -> None:
    """K4: an empty cluster takes the vector that is placed worst; of several, in the order of their cost."""
    row = f"corpus {kind}, cost long, h long, x array<int>"
    name_type = to_arrow_type(table.schema["corpus"].dataType)

    def worst(name, ids, h, x, scores):
        cost = _costs(scores)
        at = np.lexsort((h, -cost))[: len(empty[name])]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), name_type), pa.array(cost[at]), pa.array(h[at]), pa.array(x[at].astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["corpus", "cost", "h", "x"])

    place = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("cost"), "h"))
    found = _scan(table, {name: centres[name] for name in empty}, worst, row).withColumn("place", place).filter(F.col("place") <= max(map(len, empty.values())))
    for r in found.toLocalIterator():
        if r.place <= len(empty[r.corpus]) and r.cost > 0:
            centres[r.corpus][empty[r.corpus][r.place - 1]] = np.array(r.x, np.float64)


def _fitted(table: DataFrame, sizes: dict[object, int], kind: str, seed: int) -> tuple[Centres, dict]:
    """Centres of each corpus, and the counts of their clusters."""
    centres = _seeds(table, sizes, kind, seed)
    for turn in range(ROUNDS + 1):
        sums = _sums(table, centres, kind)
        moved, empty = False, {}
        for name, c in centres.items():
            own = sums.get(name, {})
            new = np.array([_on_grid(own[j][1]) if j in own and own[j][1].any() else c[j] for j in range(len(c))])
            empty |= {name: gaps} if (gaps := [j for j in range(len(c)) if j not in own]) else {}
            moved |= bool((new != c).any())
            if turn < ROUNDS:
                centres[name] = new
        if turn == ROUNDS or not moved and not empty:
            break
        if empty:
            before = {name: centres[name].copy() for name in empty}
            _repaired(table, centres, empty, kind)
            if not moved and all((before[name] == centres[name]).all() for name in empty):
                break
    return centres, {name: [own.get(j, (0,))[0] for j in range(len(centres[name]))] for name, own in sums.items()}


def clustered(rows: DataFrame, size, seed: int, least: int = 1) -> DataFrame:
    """corpus, id, cluster (numbered by size from 0). rows: corpus, id, embedding; size: column of k from `n`, the rows of a corpus.

    Corpora of fewer than `least` rows have none; one with fewer different vectors than k has fewer clusters. Vectors of a
    corpus are all of one length; a row without one is left out. Corpora are done in waves whose centres have WAVE_NUMBERS
    numbers or so.
    """
    kind = dict(rows.dtypes)["corpus"]
    table = gridded(rows.filter(F.col("embedding").isNotNull() & F.col("corpus").isNotNull()))
    table = written(table.repartitionByRange("corpus", "h"), "vectors-on-grid")
    plan = table.groupBy("corpus").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("_d")).filter(F.col("n") >= least)
    plan = written(plan.select("corpus", size.cast("int").alias("k"), (size * F.col("_d")).alias("_numbers")), "clusters-wanted")
    waves = max(1, -(-int(plan.agg(F.sum("_numbers")).first()[0] or 0) // WAVE_NUMBERS))
    out = None
    for wave in range(waves):
        mine = F.pmod(F.xxhash64("corpus"), F.lit(waves)) == wave
        sizes = {r.corpus: r.k for r in plan.filter(mine).select("corpus", "k").toLocalIterator()}
        part = table.filter(mine)
        centres, counts = _fitted(part, sizes, kind, seed) if sizes else ({}, {})
        ranks = {name: np.argsort(np.lexsort((np.arange(len(n)), -np.array(n)))) for name, n in counts.items()}
        name_type = to_arrow_type(table.schema["corpus"].dataType)

        def emit(name, ids, h, x, scores, ranks=ranks, name_type=name_type):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), name_type), ids, pa.array(ranks[name][scores.argmax(axis=1)].astype(np.int32))], names=["corpus", "id", "cluster"])

        own = _scan(part, centres, emit, f"corpus {kind}, id {dict(rows.dtypes)['id']}, cluster int")
        own = written(own, "clusters") if waves > 1 else own
        out = own if out is None else out.unionByName(own)
    forget(plan)
    return out
