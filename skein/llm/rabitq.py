"""Near-duplicate vectors by randomised-rotation binary codes with correction factors (after Gao and Long, 2024).

1. Equal vectors form one class, so copies never meet in pairs.
2. A vector is padded, turned by a random rotation, and kept as a packed code of signs with the factor <code, vector>,
   beside a copy of 4 bits a component. The product of one vector's code and another's turned copy, over the first one's
   factor, is an unbiased estimate of their cosine, within a known deviation.
3. Candidates share the bucket of a cross-polytope hash (the greatest coordinate after a rotation) in one of several
   tables, whose number follows from MISS, the chance to miss a pair at the threshold. Buckets are dealt to tasks by
   size, large ones in pairs of chunks. Only codes, factors and copies are shuffled: a pair whose bound is below the
   threshold is dropped, a pair that met in an earlier table too, and a bucket names the vectors that have a pair left.
4. Vectors are fetched for those buckets' named members only, and their pairs computed again in double precision.
   Tasks give counts and a spanning tree of each bucket's links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .graph import components
from .vectors import dimension, matrix, unit, usable

MISS = 1e-4
#: Deviations of the estimate beyond which a pair is ruled out (its chance is below 1e-6), and bits of a code at least.
DEVIATIONS, LEAST_BITS = 5.0, 128
#: Rows of a bucket aimed at, of a task (codes, vectors), of a chunk of a large bucket; rows up to which a bucket's pairs are listed.
BUCKET_ROWS, TASK_CODES, TASK_ROWS, CHUNK_ROWS, SMALL_BUCKET = 1000, 16_384, 4096, 1024, 32
#: Keys of groups are broadcast up to so many (16 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 500_000
#: A bucket's key holds the place of its table above so many bits.
PLACE_BITS = 48


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def polytope(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """2 * (greatest coordinate after the rotation), plus 1 if it is positive."""
    y = x @ turn
    at = np.abs(y).argmax(axis=1)
    return 2 * at + (y[np.arange(len(y)), at] > 0)


def plan(n: int, dim: int, threshold: float) -> tuple[int, int]:
    """Hashes a table and tables for n vectors; the chance to meet at the threshold is measured on random pairs."""
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(2, 20_000, dim))
    x = unit(x)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * (unit(z) if dim > 1 else z)
    turn = rotation(dim, 1)
    hit = max(0.02, float((polytope(x, turn) == polytope(y, turn)).mean()) - 0.01)
    hashes = max(1, math.ceil(math.log(max(1, n / BUCKET_ROWS)) / math.log(2 * max(2, dim)))) if dim > 1 else 1
    hashes = min(hashes, max(1, int(PLACE_BITS * math.log(2) / math.log(2 * dim))))
    return hashes, max(1, math.ceil(math.log(MISS) / math.log(1 - min(0.9999, hit**hashes))))


def table_keys(x: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """Each vector's bucket in each table."""
    out = np.empty((len(x), tables), np.int64)
    for t in range(tables):
        key = np.zeros(len(x), np.int64)
        for k in range(hashes):
            key = key * (2 * x.shape[1]) + polytope(x, rotation(x.shape[1], 100 + t * hashes + k))
        out[:, t] = key
    return out


class Coder:
    """Packs unit vectors: code (signs of the turned, padded vector), factor, copy of 4 bits a component, buckets."""

    def __init__(self, dim: int, hashes: int, tables: int) -> None:
        self.dim, self.bits = dim, max(LEAST_BITS, 64 * math.ceil(dim / 64))
        self.turn = rotation(self.bits, 2)[:dim].astype(np.float32)
        widest = hashes * math.log2(2 * dim)
        key = next(k for bits, k in ((8, "u1"), (16, "<u2"), (32, "<u4"), (64, "<u8")) if widest <= bits)
        self.kind = np.dtype([("factor", "<f4"), ("scale", "<f4"), ("off", "<f4"), ("code", "u1", self.bits // 8), ("copy", "u1", -(-dim // 2)), ("keys", key, (tables,))])

    def packed(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), self.kind)
        y = x.astype(np.float32) @ self.turn
        out["code"] = np.packbits(y >= 0, axis=1)
        out["factor"] = np.abs(y).sum(axis=1) / math.sqrt(self.bits)
        scale = np.abs(x).max(axis=1) / 7.5
        level = np.clip(np.rint(x / scale[:, None] + 7.5), 0, 15).astype(np.uint8)
        out["scale"], out["off"] = scale, np.sqrt((((level - 7.5) * scale[:, None] - x) ** 2).sum(axis=1))
        if self.dim % 2:
            level = np.concatenate([level, np.zeros((len(x), 1), np.uint8)], axis=1)
        out["copy"], out["keys"] = (level[:, ::2] << 4) | level[:, 1::2], keys
        return out

    def unpacked(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind)

    def signs(self, rows: np.ndarray) -> np.ndarray:
        """Codes as rows of +-1 / sqrt(bits)."""
        return (np.unpackbits(rows["code"], axis=1).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(self.bits))

    def turned(self, rows: np.ndarray) -> np.ndarray:
        level = np.stack([rows["copy"] >> 4, rows["copy"] & 15], axis=2).reshape(len(rows), -1)[:, : self.dim]
        return ((level.astype(np.float32) - 7.5) * rows["scale"][:, None]) @ self.turn

    def margins(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bound of an estimate's error is the first one's of its code plus the second one's of its code times the copy's `off`."""
        f = np.maximum(rows["factor"].astype(np.float64), 1e-6)
        wide = DEVIATIONS * np.sqrt(np.maximum(0, 1 - f**2)) / f / math.sqrt(max(1, self.bits - 1))
        return wide.astype(np.float32), (DEVIATIONS / f / math.sqrt(self.bits)).astype(np.float32)


class Bucketed:
    """Rows of a task by bucket, with the pairs whose estimate may reach the threshold and that met in no earlier table."""

    def __init__(self, table: pa.Table, coder: Coder, threshold: float) -> None:
        table = table.combine_chunks()
        self.table, self.threshold = table, threshold
        self.key, self.own, self.cls = (table.column(c).to_numpy() for c in ("key", "own", "cls"))
        self.rows = coder.unpacked(table.column("code"))
        self.place = (self.key >> PLACE_BITS).astype(np.int64)
        self.code, self.turned = coder.signs(self.rows), coder.turned(self.rows)
        self.wide, self.slack = coder.margins(self.rows)
        self.order = np.lexsort((self.cls, self.key))
        self.bounds = np.flatnonzero(np.concatenate([[True], self.key[self.order][1:] != self.key[self.order][:-1], [True]])) if len(self.key) else np.zeros(1, int)

    def _apart(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return ((self.own[p] != self.own[q]) | (self.own[p] < 0)) & (self.cls[p] != self.cls[q])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of buckets with few rows: the two rows of each pair."""
        sizes, f, off = np.diff(self.bounds), self.rows["factor"], self.rows["off"]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL_BUCKET)]):
            rows = self.order[self.bounds[:-1][sizes == size][:, None] + np.arange(size)]
            a, b = np.triu_indices(size, 1)
            i, j = rows[:, a].ravel(), rows[:, b].ravel()
            for low in range(0, len(i), 1 << 17):
                p, q = i[low : low + (1 << 17)], j[low : low + (1 << 17)]
                stay = self._apart(p, q)
                p, q = p[stay], q[stay]
                one, two = (np.einsum("ij,ij->i", self.code[x], self.turned[y]) / f[x] + self.wide[x] + self.slack[x] * off[y] for x, y in ((p, q), (q, p)))
                stay = np.maximum(one, two) >= self.threshold
                p, q = p[stay], q[stay]
                met = (self.rows["keys"][p] == self.rows["keys"][q]) & (np.arange(self.rows["keys"].shape[1]) < self.place[p][:, None])
                stay = ~met.any(axis=1)
                yield p[stay], q[stay]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of other buckets: the rows, and which pairs of them."""
        sizes, f, off = np.diff(self.bounds), self.rows["factor"], self.rows["off"]
        for low, size in zip(self.bounds[:-1][sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
            rows = self.order[low : low + size]
            bound = (self.code[rows] @ self.turned[rows].T) / f[rows][:, None]
            bound += self.wide[rows][:, None]
            bound += self.slack[rows][:, None] * off[rows][None]
            mask = bound >= self.threshold
            mask |= mask.T
            mask &= self._apart(rows[:, None], rows[None])
            keys, before = self.rows["keys"][rows], int(self.place[rows[0]])
            if mask.mean() > 0.02:
                for t in range(before):
                    mask &= keys[:, t][:, None] != keys[:, t][None]
            else:
                i, j = np.nonzero(mask)
                stay = ~(keys[i, :before] == keys[j, :before]).any(axis=1)
                mask[:] = False
                mask[i[stay], j[stay]] = True
            yield rows, mask


def named_rows(table: pa.Table, coder: Coder, threshold: float) -> pa.Table:
    """table: key, own (chunk or -1), cls, code. key, cls of the rows that have a pair to be computed again."""
    b = Bucketed(table, coder, threshold)
    some = np.zeros(len(b.cls), bool)
    for p, q in b.pairs():
        some[p] = some[q] = True
    for rows, mask in b.blocks():
        some[rows] |= mask.any(axis=1)
    return pa.table({"key": pa.array(b.key[some]), "cls": pa.array(b.cls[some])})


def _forest(mask: np.ndarray) -> np.ndarray:
    """Least index reachable in a symmetric boolean matrix, for each row."""
    label = np.arange(len(mask))
    while True:
        now = np.minimum(label, np.where(mask, label[None, :], len(mask)).min(axis=1))
        now = now[now]
        if (now == label).all():
            return label
        label = now


def bucket_links(table: pa.Table, coder: Coder, threshold: float) -> pa.Table:
    """table: as above, with m (vectors of the class) and embedding. Gives a, b, n: counts of links (b null) and a spanning forest of them."""
    b = Bucketed(table, coder, threshold)
    m, cls = b.table.column("m").to_numpy(), b.cls
    x = unit(matrix(b.table.column("embedding"), coder.dim))
    counts, links = np.zeros(len(cls), np.int64), []
    for p, q in b.pairs():
        stay = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
        p, q = p[stay], q[stay]
        np.add.at(counts, p, m[q])
        np.add.at(counts, q, m[p])
        links += zip(cls[p].tolist(), cls[q].tolist(), strict=True)
    for rows, mask in b.blocks():
        if mask.mean() > 0.02:
            mask &= x[rows] @ x[rows].T >= threshold
        else:
            i, j = np.nonzero(mask)
            stay = np.einsum("ij,ij->i", x[rows[i]], x[rows[j]]) >= threshold
            mask[:] = False
            mask[i[stay], j[stay]] = True
        mask &= mask.T
        counts[rows] += mask @ m[rows]
        tree = _forest(mask)
        up = np.flatnonzero(tree != np.arange(len(tree)))
        links += zip(cls[rows[up]].tolist(), cls[rows[tree[up]]].tolist(), strict=True)
    some = np.flatnonzero(counts)
    a = np.concatenate([cls[some], np.array([p for p, _ in links], np.int64)])
    to = pa.array([None] * len(some) + [q for _, q in links], pa.int64())
    return pa.table({"a": pa.array(a, pa.int64()), "b": to, "n": pa.array(np.concatenate([counts[some], np.zeros(len(links), np.int64)]), pa.int64())})


def _dealt(met: DataFrame, sizes: DataFrame, per_task: int) -> DataFrame:
    """met: key, cls, ...; sizes: key, size (2 at least). Adds own (chunk or -1) and task; rows of large buckets once for each other chunk."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    tasks, cols = max(1, math.ceil(total / per_task)), met.columns
    dealt = met.join(sizes, "key").withColumn("chunks", F.ceil(F.col("size") / CHUNK_ROWS).cast("int"))
    dealt = dealt.withColumn("own", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("cls"), F.col("chunks"))).otherwise(-1).cast("int"))
    small = dealt.filter("chunks = 1").select(*cols, "own", F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task"))
    pairs = dealt.filter("chunks > 1").select(*cols, "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    apart = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    own: Column = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).cast("int")
    return small.unionByName(pairs.select(*cols, own.alias("own"), apart.alias("task")))


def near_vectors(rows: DataFrame, threshold: float = 0.9, dim: int | None = None) -> DataFrame:
    """rows: vec_id long, embedding (array of numbers); other columns are not read. Links cosines >= threshold.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept (vec_id =
    component_id), one row an input row. dim: the vectors' length; without it, the one that most usable vectors have
    (of ties the greater). Vectors that are null, empty, zero, not finite or of another length link with nothing. Equal
    vectors link with each other, repeated rows too; classes of equal vectors are told apart by 64-bit hashes. Rows
    with a null vec_id link like others and are not kept. An empty table gives an empty result. A pair at the threshold
    is missed with chance MISS.
    """
    rows = rows.select("vec_id", "embedding")
    dim = dim or dimension(rows)
    good = usable() & (F.size("embedding") == dim)
    n = rows.filter(good).count()
    hashes, tables = plan(n, dim, threshold) if dim else (1, 1)
    coder = Coder(dim or 1, hashes, tables)
    classes = rows.withColumn("cls", F.when(good, F.xxhash64(F.col("embedding").cast("array<double>"))))
    reps = classes.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("m"), F.first("embedding").alias("embedding"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(2), dim))
            keys = table_keys(x, hashes, tables)
            codes = [r.tobytes() for r in coder.packed(x, keys)]
            keys = keys + (np.arange(tables, dtype=np.int64) << PLACE_BITS)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(codes, pa.binary()), lists], names=["cls", "m", "embedding", "code", "keys"])

    reps = written(reps.mapInArrow(keyed, f"cls long, m long, embedding {dict(rows.dtypes)['embedding']}, code binary, keys array<long>"), "rabitq-classes")
    met = reps.select("cls", "code", F.explode("keys").alias("key"))
    sizes = written(met.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "rabitq-buckets")
    named = _dealt(met, sizes, TASK_CODES).select("task", "key", "own", "cls", "code").groupBy("task").applyInArrow(lambda t: named_rows(t, coder, threshold), "key long, cls long")
    named = written(named.distinct(), "rabitq-named")
    left = written(named.groupBy("key").agg(F.count("*").alias("size")), "rabitq-left")
    again = _dealt(named.join(reps.select("cls", "code", "m", "embedding"), "cls").select("key", "cls", "code", "m", "embedding"), left, TASK_ROWS)
    found = again.select("task", "key", "own", "cls", "code", "m", "embedding").groupBy("task").applyInArrow(lambda t: bucket_links(t, coder, threshold), "a long, b long, n long")
    found = written(found, "rabitq-links")
    degree = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(found.filter("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    facts = reps.select("cls", "m").join(degree.withColumnRenamed("a", "cls"), "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    facts = facts.select("cls", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("_group"))
    facts = written(facts.filter("n_links > 0"), "rabitq-facts")
    few = facts.count() <= BROADCAST_ROWS
    linked = written(classes.drop("embedding").join(F.broadcast(facts) if few else facts, "cls", "left"), "rabitq-groups")
    least = linked.filter("_group is not null").groupBy("_group").agg(F.min("vec_id").alias("_least"))
    out = linked.join(F.broadcast(least) if few else least, "_group", "left")
    for x in (sizes, named, left, found):
        forget(x)
    out = out.withColumn("component_id", F.when(F.col("_group").isNull(), F.col("vec_id")).otherwise(F.col("_least")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
