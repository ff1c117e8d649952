"""Scoring by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Counts of all words of the training texts come first: they give the unigram base, the model's buckets and the noise.
The most frequent words have a bucket each; all others share buckets by hash, so that every word has vectors, however
many words there are. The model predicts a word's bucket from the word before it:

    score(w | v) = R[v] . Q[w] + b[w]          P(w | v) = exp(score(w | v)) / Z(v)

and a word of a shared bucket has its smoothed share of that bucket. Words that training never saw share bucket 0,
whose vectors learn from the words that stand once: each such token also counts as one of a word never seen.

Each task trains on all tokens of its texts from the same start. A row of R or Q is then averaged over the tasks,
weighted by how often each has used it, so what a single task learnt of a rare word stays. As Z depends on one bucket
only, blocks of R times Q give all normalisers once, and every probability is exact.

Counts of the most frequent words (a bounded number) go to every task; those of all other words are joined by a
shuffle of the rare words alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trimmed, written
from .words import Words, chunks, split

#: Stands for the end of a text. Buckets: 0 words never seen, 1 the end, then words of their own, then shared ones.
END = np.uint64(0x00E0D0000000001)
UNSEEN, LAST, OWN = 0, 1, 2
#: Words whose counts every task gets at most (16 bytes each); counts kept before they are passed on; rows of a normaliser's block.
HEAD_WORDS, FLUSH, NORM_ROWS = 1 << 19, 1 << 20, 128


@dataclass(frozen=True)
class Fit:
    """How a model is trained.

    buckets at most (half of them shared, if there are more words), numbers a vector (size) and length of the first
    vectors (start), noise samples and tokens of a batch, step of the first round (later ones fall towards a fifth of
    it), rounds over all tokens, tokens of a task aimed at (each task gives a model).
    """

    buckets: int = 1 << 16
    size: int = 64
    start: float = 1.0
    noise: int = 64
    batch: int = 1024
    step: float = 0.25
    rounds: int = 1
    task_tokens: int = 8_000_000


@dataclass
class Counts:
    """keys (sorted hashes) and counts of the frequent words, and totals of all: tokens, types, words that stand once."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    once: int = 0

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        return at, (self.keys[at] == h) if len(self.keys) else np.zeros(len(h), bool)


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words with END after each text, and bounds."""
    n = len(words.doc) - 1
    out = np.insert(words.hashes(), words.doc[1:], END) if n else np.zeros(0, np.uint64)
    return out, words.doc + np.arange(n + 1)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), held_out: crc32 of the id's text (null: of the empty one) leaves 1 modulo 5."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), (crc % 5 == 1).alias("held_out"))


def word_counts(texts: DataFrame) -> DataFrame:
    """h, c: how often each token (by hash) stands in `texts` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, waiting = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            all_, n = np.concatenate(keys), np.concatenate(sums)
            found, at = np.unique(all_, return_inverse=True)
            return found, np.bincount(at, n, len(found)).astype(np.int64)

        def batch_of(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

        for batch in batches:
            for _, body, at in chunks(batch.column(0)):
                h, c = np.unique(tokens(split(body, at))[0], return_counts=True)
                keys.append(h)
                sums.append(c)
                waiting += len(h)
            if waiting > FLUSH:
                h, c = merged()
                if len(h) > FLUSH // 2:
                    yield batch_of(h, c)
                    keys, sums, waiting = [], [], 0
                else:
                    keys, sums, waiting = [h], [c], len(h)
        if keys:
            yield batch_of(*merged())

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int) -> Counts:
    """The words above the least count that at most `most` words exceed; END is always among the totals."""
    total, types = counts.agg(F.sum("c"), F.count("*")).first()
    often = counts.groupBy("c").agg(F.count("*").alias("n")).filter("n > 0")
    level, seen, often = 0, 0, sorted(((int(r[0]), int(r[1])) for r in often.toLocalIterator()), reverse=True)
    for c, n in often:
        if seen + n > most:
            level = c
            break
        seen += n
    got = counts.filter(F.col("c") > level).toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(h)
    return Counts(h[order], c[order], int(total or 0), int(types or 0), sum(n for c, n in often if c == 1))


@dataclass
class Buckets:
    """Which bucket a word is in. keys (sorted hashes), ids: of words with a bucket of their own; shared: how many others.

    mass: smoothed counts of the buckets. often: words (sorted hashes) that stand more than once, as far as the head
    tells; of the tokens of all others the share `once` also counts as never seen.
    """

    keys: np.ndarray
    ids: np.ndarray
    shared: int
    mass: np.ndarray
    often: np.ndarray
    once: float

    def single(self, h: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Places of tokens that also count as never seen."""
        at = np.minimum(np.searchsorted(self.often, h), max(0, len(self.often) - 1))
        rare = (self.often[at] != h if len(self.often) else np.ones(len(h), bool)) & (h != END)
        return np.flatnonzero(rare & (rng.random(len(h)) < self.once))

    def of(self, h: np.ndarray) -> np.ndarray:
        out = OWN + len(self.keys) + np.mod(h.view(np.int64), self.shared) if self.shared else np.full(len(h), UNSEEN)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out = np.where(self.keys[at] == h, self.ids[at], out)
        return np.where(h == END, LAST, out).astype(np.int32)


def bucketed(head: Counts, counts: DataFrame, most: int) -> Buckets:
    """At most `most` buckets. Only one row for each shared bucket reaches the driver."""
    order = np.lexsort((head.keys, -head.counts))
    own = order[head.keys[order] != END]
    every = len(own) + 1 >= head.types and len(own) + OWN <= most
    own = own if every else own[: most // 2 - OWN]
    shared = 0 if every else most // 2
    at = np.sort(own)
    place = np.full(len(head.keys), -1)
    place[own] = np.arange(len(own))
    keys, ids = head.keys[at], OWN + place[at]
    until = OWN + len(own)
    mass = np.full(until + shared, 0.5)
    mass[ids] = head.counts[at] + 0.5
    mass[UNSEEN] = head.once + 0.5
    there = head.places(np.array([END], np.uint64))
    mass[LAST] = (head.counts[there[0][0]] if there[1][0] else 0) + 0.5
    if shared:
        rows = counts.groupBy(F.pmod(F.col("h"), F.lit(shared)).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
        total = np.zeros(shared)
        total[rows.column("k").to_numpy()] = rows.column("c").to_numpy() + 0.5 * rows.column("n").to_numpy()
        total -= np.bincount(np.mod(keys.view(np.int64), shared), head.counts[at] + 0.5, shared)
        if there[1][0]:
            total[int(np.mod(np.int64(END), shared))] -= head.counts[there[0][0]] + 0.5
        mass[until:] = np.maximum(total, 0) + 1e-3
    often = head.counts > 1
    rest = head.tokens - head.counts[often].sum()
    return Buckets(keys, ids, shared, mass, head.keys[often], head.once / rest if rest else 0.0)


@dataclass
class Model:
    """r, q, b, and how often (weights) and how steeply (slopes) each row of r and q was moved."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    weights: np.ndarray
    slopes: np.ndarray

    @staticmethod
    def started(mass: np.ndarray, fit: Fit) -> Model:
        rng, n = np.random.default_rng(5), len(mass)
        first = lambda: rng.standard_normal((n, fit.size), np.float32) * np.float32(fit.start / math.sqrt(fit.size))
        return Model(first(), first(), np.log(mass / mass.sum()).astype(np.float32), np.zeros((2, n), np.float32), np.full((3, n), 1e-6, np.float32))

    def packed(self) -> bytes:
        return b"".join([self.r.astype(np.float16).tobytes(), self.q.astype(np.float16).tobytes(), self.b.tobytes(), self.weights.tobytes(), self.slopes.tobytes()])

    @staticmethod
    def unpacked(x: bytes, n: int, size: int) -> Model:
        out, at = [], 0
        for shape, kind in (((n, size), np.float16), ((n, size), np.float16), ((n,), np.float32), ((2, n), np.float32), ((3, n), np.float32)):
            length = int(np.prod(shape)) * np.dtype(kind).itemsize
            out.append(np.frombuffer(x[at : at + length], kind).reshape(shape).astype(np.float32))
            at += length
        return Model(*out)

    def joined(self, other: Model) -> Model:
        """The average by weight, row by row; rows that neither has moved stay as they are."""
        total = self.weights + other.weights
        part = np.where(total > 0, other.weights / np.maximum(total, 1), 0.5)
        mean = lambda x, y, p: x + p * (y - x)
        r, q = mean(self.r, other.r, part[0][:, None]), mean(self.q, other.q, part[1][:, None])
        return Model(r, q, mean(self.b, other.b, part[1]), total, self.slopes + other.slopes)

    def norms(self, low: int, high: int) -> np.ndarray:
        """log Z of the buckets low to high."""
        s = self.r[low:high].astype(np.float32) @ self.q.T
        s += self.b
        top = s.max(axis=1, keepdims=True)
        s -= top
        np.exp(s, out=s)
        return np.log(s.sum(axis=1, dtype=np.float64)) + top[:, 0]


def before(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bucket before each token; before a text stands the end."""
    v = np.concatenate([[LAST], ids[:-1]]).astype(ids.dtype) if len(ids) else ids.copy()
    v[first[:-1]] = LAST
    return v


def _summed(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of their gradients."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.add.reduceat(grad[order], first, axis=0)


class Trainer:
    """Noise-contrastive training with a step for each row that falls with its gradients so far; a batch shares its noise."""

    def __init__(self, model: Model, mass: np.ndarray, fit: Fit, step: float, seed: tuple[int, ...] = (7,)) -> None:
        self.m, self.fit, self.step, self.rng = model, fit, step, np.random.default_rng(seed)
        share = mass / mass.sum()
        self.cum, self.log_noise = np.cumsum(share), np.log(fit.noise * share).astype(np.float32)
        self.tokens = 0

    def _moved(self, kind: int, rows: np.ndarray, grad: np.ndarray) -> None:
        at, g = _summed(rows, grad)
        vectors, offsets = ((self.m.r, None), (self.m.q, self.m.b))[kind]
        size = self.fit.size
        own = g[:, :size]
        slope = self.m.slopes[kind]
        steep = slope[at] + np.einsum("ij,ij->i", own, own) / size
        slope[at] = steep
        vectors[at] += own * (self.step / np.sqrt(steep))[:, None]
        if offsets is not None:
            steep = self.m.slopes[2][at] + g[:, size] ** 2
            self.m.slopes[2][at] = steep
            offsets[at] += 0.3 * self.step * g[:, size] / np.sqrt(steep)

    def batch(self, v: np.ndarray, w: np.ndarray) -> None:
        m, size, noise = self.m, self.fit.size, self.fit.noise
        z = np.minimum(np.searchsorted(self.cum, self.rng.random(noise)), len(self.cum) - 1).astype(w.dtype)
        h, q, qz = m.r[v], m.q[w], m.q[z]
        good = np.einsum("ij,ij->i", h, q) + m.b[w] - self.log_noise[w]
        bad = h @ qz.T
        bad += m.b[z] - self.log_noise[z]
        up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        # minus the chance that a noise word is taken for data
        np.clip(bad, -30, 30, out=bad)
        np.negative(bad, out=bad)
        np.exp(bad, out=bad)
        bad += 1
        np.divide(-1, bad, out=bad)
        dh = up[:, None] * q
        dh += bad @ qz
        dq = np.empty((len(w) + noise, size + 1), np.float32)
        np.multiply(up[:, None], h, out=dq[: len(w), :size])
        dq[: len(w), size] = up
        dq[len(w) :, :size] = bad.T @ h
        dq[len(w) :, size] = bad.sum(axis=0)
        self._moved(0, v, dh)
        self._moved(1, np.concatenate([w, z]), dq)
        m.weights[1][z] += 1

    def texts(self, ids: np.ndarray, first: np.ndarray, single: np.ndarray = np.zeros(0, np.int64)) -> None:
        """single: places of tokens that also count as never seen, both as the word and as the one before."""
        v = before(ids, first)
        if len(single):
            later = single + 1
            later = later[later < len(ids)]
            later = later[v[later] == ids[later - 1]]
            both = np.concatenate([np.arange(len(ids)), single, later])
            order = np.argsort(both, kind="stable")
            v = np.concatenate([v, v[single], np.full(len(later), UNSEEN, v.dtype)])[order]
            ids = np.concatenate([ids, np.full(len(single), UNSEEN, ids.dtype), ids[later]])[order]
        self.m.weights[0] += np.bincount(v, minlength=len(self.cum))
        self.m.weights[1] += np.bincount(ids, minlength=len(self.cum))
        self.tokens += len(ids)
        for low in range(0, len(ids), self.fit.batch):
            self.batch(v[low : low + self.fit.batch], ids[low : low + self.fit.batch])


def _round(texts: DataFrame, model: Model, buckets: Buckets, fit: Fit, k: int) -> Model:
    """Round k: every task trains from `model`; their average is formed in a tree of tasks."""
    context, n = texts.sparkSession.sparkContext, len(buckets.mass)
    model.weights[:] = 0
    start = context.broadcast((model.packed(), buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, buckets = start.value
        trainer = Trainer(Model.unpacked(packed, n, fit.size), buckets.mass, fit, fit.step * (1 - 0.8 * k / fit.rounds), (k, TaskContext.get().partitionId()))
        for batch in batches:
            for _, body, at in chunks(batch.column(0)):
                h, first = tokens(split(body, at))
                trainer.texts(buckets.of(h), first, buckets.single(h, trainer.rng))
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays([pa.array([trainer.m.packed()], pa.binary())], names=["model"])

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                part = Model.unpacked(x.as_py(), n, fit.size)
                total = part if total is None else total.joined(part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.packed()], pa.binary())], names=["model"])

    models = texts.select("text").mapInArrow(run, "model binary")
    width = max(1, texts.rdd.getNumPartitions())
    while width > 1:
        width = -(-width // 16)
        models = models.repartition(width).mapInArrow(averaged, "model binary")
    rows = models.collect()
    start.destroy()
    return Model.unpacked(bytes(rows[0]["model"]), n, fit.size) if rows else model


def trained(texts: DataFrame, n_tokens: int, buckets: Buckets, fit: Fit) -> Model:
    """texts: text. Rounds over all tokens, with a falling step."""
    width = max(1, math.ceil(n_tokens / fit.task_tokens))
    texts = texts.select("text")
    texts = texts.coalesce(width) if width < texts.rdd.getNumPartitions() else texts
    model = Model.started(buckets.mass, fit)
    for k in range(fit.rounds):
        model = _round(texts, model, buckets, fit, k)
    return model


def normalisers(spark: SparkSession, vectors: Broadcast, n: int) -> np.ndarray:
    """log Z of every bucket, by blocks dealt to tasks. vectors: r, q, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, q, b = vectors.value
        whole = Model(r, q.astype(np.float32), b, np.zeros(0), np.zeros(0))
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([whole.norms(k * NORM_ROWS, (k + 1) * NORM_ROWS).tolist()], pa.list_(pa.float64()))], names=["k", "z"])

    rows = spark.range(math.ceil(n / NORM_ROWS)).mapInArrow(run, "k long, z array<double>").collect()
    return np.concatenate([np.array(z) for _, z in sorted((r["k"], r["z"]) for r in rows)])


def scored(docs: DataFrame, fit: Fit = Fit(), head_words: int = HEAD_WORDS) -> DataFrame:
    """docs: doc_id, text; other columns are not read. One row an input row:

    doc_id, held_out, n_tokens (words and one end), n_known (tokens with a count in training), train_tokens,
    base_score (smoothed unigram) and score (the model), both log10 probabilities of the whole text.

    Training texts are those not held out. Words are A-Z lower-cased runs of bytes outside 0x20 and 0x09-0x0D. A null
    or empty text is one end. Ids may be null or repeated; repeated rows get equal results. Texts of any length are
    read whole, in slices. Without training texts all counts are 0, and an empty table gives an empty result.
    """
    docs = marked(docs)
    learn = docs.filter(~F.col("held_out"))
    counts = written(word_counts(learn), "lm-counts")
    head = head_of(counts, head_words)
    buckets = bucketed(head, counts, fit.buckets)
    model = trained(learn, head.tokens, buckets, fit)
    unit = head.tokens + 0.5 * (head.types + 1)
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast((model.r.astype(np.float16), model.q.astype(np.float16), model.b))
    model = None
    trimmed()
    shared = spark.sparkContext.broadcast((head, buckets, normalisers(spark, vectors, len(buckets.mass))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, buckets, norm), (r, q, b) = shared.value, vectors.value
        r, q = r.astype(np.float32), q.astype(np.float32)
        ln10 = np.log(10.0)
        for batch in batches:
            for rows, body, at in chunks(batch.column(3)):
                h, first = tokens(split(body, at))
                place, there = head.places(h)
                c = np.where(there, head.counts[place], 0) if len(head.keys) else np.zeros(len(h))
                ids = buckets.of(h)
                v = before(ids, first)
                log = (np.einsum("ij,ij->i", r[v], q[ids]).astype(np.float64) + b[ids] - norm[v]) / ln10
                share = np.where(ids >= OWN, np.log10(buckets.mass[ids]), 0)
                log = np.where(there & (ids >= OWN), log + np.log10(c + 0.5) - share, log)
                base = np.where(there, np.log10((c + 0.5) / unit), 0)
                total = lambda x: np.add.reduceat(x, first[:-1])
                tail = np.flatnonzero(~there)
                bounds = pa.array(np.searchsorted(tail, first).astype(np.int32))
                never = (np.einsum("ij,j->i", r[v[tail]], q[UNSEEN]).astype(np.float64) + b[UNSEEN] - norm[v[tail]]) / ln10
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (h[tail].view(np.int64), log[tail] - share[tail], np.where(ids[tail] == LAST, log[tail], never))]
                columns = [batch.column(k)[rows] for k in range(3)]
                columns += [pa.array(np.diff(first).astype(np.int64)), pa.array(total(there.astype(np.int64))), pa.array(total(base)), pa.array(total(np.where(there, log, 0))), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "seen", "never"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, seen array<double>, never array<double>"
    part = written(rows.mapInArrow(run, schema), "lm-parts")
    rare = part.select("rid", F.explode(F.arrays_zip("rare", "seen", "never")).alias("t")).select("rid", F.col("t.rare").alias("h"), "t.seen", "t.never")
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = rare.join(counts, "h", "left").groupBy("rid").agg(
        F.count_if(c > 0).alias("known"),
        F.sum(F.log10((c + 0.5) / F.lit(float(unit)))).alias("base"),
        F.sum(F.when((c > 0) & (F.col("h") != int(END)), F.col("seen") + F.log10(c + 0.5)).otherwise(F.col("never"))).alias("log"),
    )
    out = part.join(rare, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(head.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("log", F.lit(0.0))).alias("score"),
    )
