"""MinHash near-duplicates: banded candidates, sequential Bayesian verification of signatures, exact set check.

1. Each text becomes its set of word shingles (64-bit hashes), a set key, a signature (a byte a hash function) and the
   keys of its bands. Texts with the same set form one class.
2. In each bucket of a band the least class leads. Signatures of members and leader are compared batch by batch: a pair
   is dropped once the posterior probability (uniform prior) of a similarity at or above the threshold is below MISS.
   Members whose pair is dropped are compared in the same way with all others of their bucket. Pairs that stay are
   survivors; a bucket gives a spanning forest of them, so rows stay linear in its size. Only signatures are shuffled.
3. The components of the survivors are the clusters within which all links lie; only their texts are fetched, each
   once. A large cluster is cut into chunks that are compared with one hub first; the texts that don't link with it
   meet all others, chunk by chunk. Survivors are checked on the full sets, a row with all others at once, and then on the
   words themselves, unless earlier links connect them already.
4. Components of the confirmed links give the groups.
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
from .words import BASE, chunks, distinct, mixed, shingles, split

#: A pair at similarity s shares no band with probability (1 - s**ROWS)**BANDS: 6.6e-6 at 0.8.
BANDS, ROWS = 30, 5
#: Signature values compared at a time, and the posterior probability under which a pair is dropped.
BATCH, MISS = 25, 1e-6
#: A task's clusters hold about so many shingles; a chunk of a large cluster at most about so many texts or shingles.
TASK_SHINGLES, CHUNK_TEXTS, CHUNK_SHINGLES = 300_000, 1000, 500_000
#: Signatures of a task, and of a chunk of a large bucket.
TASK_SIGNATURES, CHUNK_SIGNATURES = 20_000, 4096
#: Pairs of a row up to which sets are compared one by one.
FEW_PAIRS = 4
#: Shingles of words that a task keeps for the next comparison.
KEPT_SHINGLES = 300_000
#: Keys of groups and texts are broadcast up to so many (about 24 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 500_000

_rng = np.random.default_rng(20_240_901)
MASKS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
FACTORS = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts x hash functions; every segment must hold a value."""
    low = (values ^ (values >> np.uint64(20))).astype(np.uint32)
    out = np.empty((len(first) - 1, BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat((low ^ MASKS[k]) * FACTORS[k], first[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key * np.uint64(BASE) + rows[:, :, k])
    return key


def set_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Equal for equal sets, whatever else was in the chunk."""
    total = np.add.reduceat(mixed(values), first[:-1])
    return mixed(total * np.uint64(BASE) + np.diff(first).astype(np.uint64))


def text_sets(column: pa.Array, size: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of rows with their distinct shingles and bounds."""
    for rows, body, at in chunks(column):
        yield rows, *distinct(*shingles(split(body, at), size))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def profiled(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, cls (key of the set; null if empty), sig (bytes), bands (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values, first in text_sets(batch.column(2), size):
                n = np.diff(first)
                some = np.flatnonzero(n)
                cls, signs = np.zeros(len(n), np.int64), [b""] * len(n)
                keys = np.zeros(0, np.int64)
                if len(some):
                    bounds = np.append(first[:-1][some], first[-1])
                    cls[some] = set_keys(values, bounds).view(np.int64)
                    sig = signatures(values, bounds)
                    keys = band_keys(sig).view(np.int64).ravel()
                    for k, own in zip(some, short(sig), strict=True):
                        signs[k] = own.tobytes()
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(1)[rows], pa.array(n.astype(np.int64)), pa.array(cls, mask=n == 0), pa.array(signs, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(keys))],
                    names=["doc_id", "th", "n_shingles", "cls", "sig", "bands"],
                )

    text = docs.select("doc_id", text_hash().alias("th"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return text.mapInArrow(run, "doc_id long, th long, n_shingles long, cls long, sig binary, bands array<long>")


def short(sig: np.ndarray) -> np.ndarray:
    """A byte of each value. Unequal values agree once in 256, which only makes survivors more."""
    return (sig >> np.uint32(24)).astype(np.uint8)


def least_matches(threshold: float) -> np.ndarray:
    """[b]: matches among the first (b + 1) * BATCH values under which a pair is dropped.

    With a uniform prior, m matches in n give Beta(1 + m, 1 + n - m), and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, 0
        while total < MISS and m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            m += 1
        out.append(m - 1)
    return np.array(out)


def survivors(one: np.ndarray, all_: np.ndarray, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `all_` whose signature may belong to a similar text, and their matches."""
    j, hits = np.arange(len(all_)), np.zeros(len(all_), np.int64)
    for b, bar in enumerate(bars):
        if not len(j):
            break
        part = slice(b * BATCH, (b + 1) * BATCH)
        hits = hits + (all_[j, part] == one[part]).sum(1)
        stay = hits >= bar
        j, hits = j[stay], hits[stay]
    return j, hits


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _alike(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows cls, lead, n, m, sig, mark: cls, lead, ok (the pair survives)."""
    bars = least_matches(percent / 100)
    for batch in batches:
        a, b = (_bytes(batch.column(k), BANDS * ROWS) for k in (4, 5))
        n, m = (batch.column(k).to_numpy() for k in (2, 3))
        ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        hits = np.zeros(len(a), np.int64)
        for k, bar in enumerate(bars):
            part = slice(k * BATCH, (k + 1) * BATCH)
            hits += (a[:, part] == b[:, part]).sum(1)
            ok &= hits >= bar
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["cls", "lead", "ok"])


def bucket_edges(table: pa.Table, percent: int) -> pa.Table:
    """table: key, asks (0 or 1), cls, n, sig. Survivors between asking rows and all others of a bucket, as a spanning forest."""
    bars = least_matches(percent / 100)
    key, asks, cls, n = (table.column(c).to_numpy() for c in ("key", "asks", "cls", "n"))
    sig = _bytes(table.column("sig"), BANDS * ROWS)
    order = np.lexsort((n, asks, key))
    cut = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]])) if len(key) else np.zeros(1, int)
    u, v = [], []
    for low, high in zip(cut, cut[1:], strict=False):
        own = order[low:high]
        rest, every = own[asks[own] == 1], own[asks[own] == 0]
        signs, sizes, label = sig[every], n[every], np.arange(len(every))
        for i in rest:
            a, b = np.searchsorted(sizes, -(-n[i] * percent // 100)), np.searchsorted(sizes, n[i] * 100 // percent, "right")
            j, _ = survivors(sig[i], signs[a:b], bars)
            j = j + a
            j = j[cls[every[j]] != cls[i]]
            if len(j):
                groups, one = np.unique(label[j], return_index=True)
                u += [cls[i]] * len(groups)
                v += cls[every[j[one]]].tolist()
                label[np.isin(label, groups)] = groups[0]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def clusters(reps: DataFrame, percent: int) -> DataFrame:
    """reps: cls, n, sig, bands. node, component: components of the survivors."""
    met = reps.select("cls", F.explode("bands").alias("key"))
    lead = met.groupBy("key").agg(F.min("cls").alias("lead"), F.max("cls").alias("top"), F.count("*").alias("many")).filter("lead < top").drop("top")
    met = written(met.join(lead, "key"), "minhash-buckets")
    star = met.filter("cls <> lead").select("cls", "lead").distinct()
    own = reps.select("cls", "n", "sig")
    star = star.join(own, "cls").join(own.select(F.col("cls").alias("lead"), F.col("n").alias("m"), F.col("sig").alias("mark")), "lead")
    star = written(star.select("cls", "lead", "n", "m", "sig", "mark").mapInArrow(lambda x: _alike(x, percent), "cls long, lead long, ok boolean"), "minhash-stars")
    edges = star.filter("ok").select(F.col("cls").alias("u"), F.col("lead").alias("v"))
    rest = written(met.filter("many > 2").join(star.filter("not ok"), ["cls", "lead"]).select("key", "cls", "many"), "minhash-rest")
    asking = rest.groupBy("key").agg(F.max("many").alias("many"), F.count("*").alias("asking"))
    total = asking.agg(F.sum(F.col("many") + F.col("asking"))).first()[0]
    if total:
        tasks = max(1, math.ceil(total / TASK_SIGNATURES))
        parts = lambda c: F.ceil(F.col(c) / CHUNK_SIGNATURES).cast("int")
        cut = asking.select("key", parts("asking").alias("ca"), parts("many").alias("cb"))
        part = lambda c: F.pmod(F.xxhash64("cls", F.lit(c)), F.col(c)).cast("int")
        spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        ask = rest.join(cut, "key").select("key", "cls", "ca", "cb", F.lit(1).alias("asks"), part("ca").alias("a"), spread("cb").alias("b"))
        every = met.filter("cls <> lead").join(cut, "key").select("key", "cls", "ca", "cb", F.lit(0).alias("asks"), part("cb").alias("b"), spread("ca").alias("a"))
        task = F.when((F.col("ca") == 1) & (F.col("cb") == 1), F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.xxhash64("key", "a", "b"))
        dealt = ask.unionByName(every).select(task.alias("task"), "key", "cls", "asks").join(own, "cls")
        more = dealt.select("task", "key", "asks", "cls", "n", "sig").groupBy("task").applyInArrow(lambda t: bucket_edges(t, percent), "u long, v long")
        edges = edges.unionByName(more)
    near = components(edges)
    for x in (met, star, rest):
        forget(x)
    return near


class WordSets:
    """Sets of shingles as the words themselves, for the last texts asked for."""

    def __init__(self, texts: list[bytes], size: int) -> None:
        self.texts, self.size, self.known, self.room = texts, size, {}, KEPT_SHINGLES

    def of(self, i: int) -> set:
        if i not in self.known:
            words = self.texts[i].lower().split()
            own = set(zip(*(words[k:] for k in range(self.size)), strict=False)) or {tuple(words)}
            self.room -= len(own)
            if self.room < 0:
                self.known, self.room = {}, KEPT_SHINGLES - len(own)
            self.known[i] = own
        return self.known[i]

    def linked(self, i: int, j: int, percent: int) -> bool:
        a, b = self.of(i), self.of(j)
        both = len(a & b)
        return 100 * both >= percent * (len(a) + len(b) - both)


class Overlaps:
    """Sizes of intersections of a text's set with those of others, from lists of the texts that have a shingle."""

    def __init__(self, values: np.ndarray, first: np.ndarray) -> None:
        self.first, self.m = first, len(first) - 1
        _, self.ids, self.many = np.unique(values, return_inverse=True, return_counts=True)
        self.texts = np.repeat(np.arange(self.m), np.diff(first))[np.argsort(self.ids, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(self.many)])

    def of(self, i: int, j: np.ndarray) -> np.ndarray:
        own = self.ids[self.first[i] : self.first[i + 1]]
        if len(j) <= FEW_PAIRS:
            return np.array([len(np.intersect1d(own, self.ids[self.first[k] : self.first[k + 1]], assume_unique=True)) for k in j])
        own = own[self.many[own] > 1]
        many = self.many[own]
        until = np.cumsum(many)
        at = np.arange(until[-1] if len(until) else 0) + np.repeat(self.start[own] - (until - many), many)
        return np.bincount(self.texts[at], minlength=self.m)[j]


def verified(sig: np.ndarray, values: np.ndarray, first: np.ndarray, asks: np.ndarray, words: WordSets, percent: int) -> list[tuple[int, int]]:
    """Links that join groups, as indices, of pairs in which a row asks."""
    n, links, sets = np.diff(first), [], None
    bars = least_matches(percent / 100)
    order = np.argsort(n, kind="stable")
    sig, size, asks, label = sig[order], n[order], asks[order], np.arange(len(sig))
    asking = np.flatnonzero(asks)
    for i in range(len(sig) - 1):
        end = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        near = np.arange(i + 1, end) if asks[i] else asking[np.searchsorted(asking, i + 1) : np.searchsorted(asking, end)]
        near = near[label[near] != label[i]]
        j, _ = survivors(sig[i], sig[near], bars)
        j = near[j]
        if not len(j):
            continue
        sets = sets or Overlaps(values, first)
        both = sets.of(order[i], order[j])
        for k in j[100 * both >= percent * (size[i] + size[j] - both)].tolist():
            if label[k] != label[i] and words.linked(int(order[i]), int(order[k]), percent):
                links.append((int(order[i]), int(order[k])))
                label[label == label[k]] = label[i]
    return links


def confirmed_links(table: pa.Table, size: int, percent: int) -> pa.Table:
    """table: cls, text, cluster, asks (1: is compared with all of its cluster's rows here, 0: with asking ones only)."""
    cls, asks, cluster = (table.column(c).to_numpy() for c in ("cls", "asks", "cluster"))
    sets, sizes, signs, texts = [], [], [], []
    for rows, values, first in text_sets(table.column("text"), size):
        full = np.diff(first) > 0
        sig = np.zeros((len(full), BANDS * ROWS), np.uint8)
        if full.any():
            sig[full] = short(signatures(values, np.append(first[:-1][full], first[-1])))
        sets.append(values)
        sizes.append(np.diff(first))
        signs.append(sig)
        texts += [x.encode() for x in table.column("text")[rows].to_pylist()]
    sig, n, values = np.concatenate(signs), np.concatenate(sizes), np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum(n)])
    order = np.lexsort((-asks, cls, cluster))
    order = order[np.concatenate([[True], (cls[order][1:] != cls[order][:-1]) | (cluster[order][1:] != cluster[order][:-1])])]
    cut = np.flatnonzero(np.concatenate([[True], cluster[order][1:] != cluster[order][:-1], [True]]))
    u, v = [], []
    for low, high in zip(cut, cut[1:], strict=False):
        own = order[low:high]
        bounds = np.concatenate([[0], np.cumsum(n[own])])
        at = np.repeat(first[own] - bounds[:-1], n[own]) + np.arange(bounds[-1])
        words = WordSets([texts[i] for i in own], size)
        for a, b in verified(sig[own], values[at], bounds, asks[own] == 1, words, percent):
            u.append(cls[own[a]])
            v.append(cls[own[b]])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def links(docs: DataFrame, cand: DataFrame, rows: int, total: int, size: int, percent: int) -> DataFrame:
    """cand: cls, th, n, cluster (`rows` rows of `total` shingles). u, v: confirmed links that join all that is linked in a cluster."""
    key = cand.select(F.col("th").alias("_th"), "cls", "cluster", "n")
    key = F.broadcast(key) if rows <= BROADCAST_ROWS else key
    texts = docs.select(text_hash().alias("_h"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = written(texts.join(key, F.col("_h") == F.col("_th")).select("cls", "cluster", "n", "text").dropDuplicates(["cls"]), "minhash-texts")
    big = F.greatest(F.ceil(F.count("*") / CHUNK_TEXTS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    sizes = cand.groupBy("cluster").agg(big.alias("chunks"), F.min("cls").alias("hub"))
    sizes = written(sizes, "minhash-clusters")
    few = F.broadcast(sizes) if rows <= BROADCAST_ROWS else sizes
    texts = texts.join(few, "cluster")
    check = lambda df: written(df.select("task", "cluster", "cls", "asks", "text").groupBy("task").applyInArrow(lambda t: confirmed_links(t, size, percent), "u long, v long"), "minhash-links")
    tasks = max(1, math.ceil(total / TASK_SHINGLES))
    found = check(texts.filter("chunks = 1").withColumn("task", F.pmod(F.xxhash64("cluster"), F.lit(tasks))).withColumn("asks", F.lit(1)))
    large = texts.filter("chunks > 1")
    if not sizes.filter("chunks > 1").isEmpty():
        hub = F.col("cls") == F.col("hub")
        part = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
        every = F.sequence(F.lit(0), F.col("chunks") - 1)
        stars = large.withColumn("asks", F.when(hub, 1).otherwise(0)).withColumn("part", F.explode(F.when(hub, every).otherwise(F.array(part))))
        stars = check(stars.withColumn("task", F.xxhash64("cluster", "part")))
        # what links with the hub is one group already; all other rows may link with anything
        near = stars.select(F.col("u").alias("cls")).unionByName(stars.select(F.col("v").alias("cls"))).unionByName(sizes.select(F.col("hub").alias("cls"))).distinct()
        alone = written(cand.join(sizes.filter("chunks > 1"), "cluster").select("cluster", "cls", "n").join(near, "cls", "left_anti"), "minhash-alone")
        crowd = alone.groupBy("cluster").agg(big.alias("ca"))
        large = large.join(crowd, "cluster").join(alone.select("cls", F.lit(1).alias("asks")), "cls", "left").fillna(0, ["asks"])
        mine, others = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("ca")).cast("int"), F.sequence(F.lit(0), F.col("ca") - 1)
        ask = large.filter("asks = 1").withColumn("a", mine).withColumn("b", F.explode(every))
        rest = large.withColumn("b", part).withColumn("a", F.explode(others)).withColumn("asks", F.lit(0))
        rest = check(ask.unionByName(rest.select(ask.columns)).withColumn("task", F.xxhash64("cluster", "a", "b")))
        found = found.unionByName(stars).unionByName(rest)
    return found


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """A table of doc_id, th (hash of the text), n_shingles, _group (of linked texts; null without shingles), one row an input row."""
    base = written(profiled(docs, size), "minhash-profiles")
    reps = base.filter("cls is not null").groupBy("cls").agg(F.min("th").alias("th"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = written(reps, "minhash-classes")
    near = clusters(reps, percent)
    cand = written(near.select(F.col("node").alias("cls"), F.col("component").alias("cluster")).join(reps.select("cls", "th", "n"), "cls"), "minhash-candidates")
    rows, total = cand.agg(F.count("*"), F.sum("n")).first()
    if rows:
        near = components(links(docs, cand, rows, total, size, percent))
    named = near.select(F.col("node").alias("cls"), "component")
    named = F.broadcast(named) if rows <= BROADCAST_ROWS else named
    return written(base.select("doc_id", "th", "n_shingles", "cls").join(named, "cls", "left").select("doc_id", "th", "n_shingles", F.coalesce("component", "cls").alias("_group")), "minhash-groups")


def _chosen(rows: DataFrame, place: Column) -> DataFrame:
    """`rows` (with _group) and _first, the least `place` of the group; null in groups of one row.

    Groups of two and more are broadcast up to a bound; beyond it their key is salted, as one may hold a third of all rows.
    """
    least = written(rows.filter("_group is not null").groupBy("_group").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "minhash-least")
    if least.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(least), "_group", "left")
    salt = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(16)).cast("int"))
    return rows.join(least.select("*", salt), ["_group", "_salt"], "left").drop("_salt")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs: doc_id long, text; other columns are not read. Links texts with 100 * intersection >= percent * union.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id), one
    row an input row. Words are lower-cased (A-Z) runs of bytes outside 0x20 and 0x09-0x0D; a text with fewer than
    `size` words is one shingle. A null or empty text has no shingles and links with nothing. Texts of any length are
    read whole. Rows with a null doc_id link like others, their component_id is null if no row of the group has an id,
    and they are not kept. Rows that share an id but not a text are told apart; repeated rows get equal results. An
    empty table gives an empty result.
    """
    out = _chosen(grouped(docs, size, percent), F.col("doc_id"))
    out = out.withColumn("component_id", F.coalesce("_first", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def distinct_rows(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` (all columns) with one row of each group of near duplicates: the first by doc_id (nulls last), then by a hash of the text.

    The choice is by row, so ids may be null or shared by other texts. Rows without shingles link with nothing and stay.
    Of rows with the same id and text one stays, whichever; their other columns may differ. An empty table gives an empty result.
    """
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    rows = _chosen(grouped(docs, size, percent).filter("_group is not null").withColumn("_place", place), F.col("_place"))
    kept = F.coalesce(F.col("_place") == F.col("_first"), F.lit(True))
    texts = rows.filter("_first is not null").groupBy("doc_id", "th").agg(F.bool_or(kept).alias("kept"), F.count("*").alias("n"))
    texts = written(texts.select(F.col("doc_id").alias("__text_id"), F.col("th").alias("__text_key"), "kept", "n"), "minhash-kept")
    gone, repeats = texts.agg(F.count_if(~F.col("kept")), F.count_if(F.col("kept") & (F.col("n") > 1))).first()
    same = F.col("doc_id").eqNullSafe(F.col("__text_id")) & (F.col("__text_hash") == F.col("__text_key"))
    drop = texts.filter("not kept").select("__text_id", "__text_key")
    out = docs.withColumn("__text_hash", text_hash())
    out = out.join(F.broadcast(drop) if (gone or 0) <= BROADCAST_ROWS else drop, same, "left_anti")
    if repeats:
        many = texts.filter("kept and n > 1").select("__text_id", "__text_key")
        many = F.broadcast(many) if repeats <= BROADCAST_ROWS else many
        out = out.join(many, same, "left_anti").unionByName(out.join(many, same, "left_semi").dropDuplicates(["doc_id", "__text_hash"]))
    return out.drop("__text_hash")
