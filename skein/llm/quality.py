"""Ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade >= k) = 1 / (1 + exp(threshold[k] - score)), with one score for all grades: the sum of the weights of a text's
distinct features (hashes of words and of runs of punctuation, and buckets of a few ratios). Thresholds rise with k.
Weights are kept under the features' hashes, so a rare word never shares the weight of another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.ranks import running

from .common import trimmed, written
from .words import SPACE, chunks, distinct, mixed, split

#: Bounds of the fit: labelled texts (those of the least hash of doc_id), and distinct features of each, summed over them. All
#: features of the texts that are taken have a weight.
SAMPLE, SAMPLE_FEATURES = 20_000, 1 << 25
STEPS, STEP, PULL, BATCH = 2000, 0.15, 3e-4, 128
#: A document is kept if the chance of the top grade is at least this.
KEEP = 0.5

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NOT_WORD, NOT_SIGN = ~ALNUM, ALNUM | SPACE


@dataclass
class OrdinalModel:
    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(first) - 1)
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        got = np.where(self.keys[at] == features, self.weights[at], 0.0)
        total = np.concatenate([[0.0], np.cumsum(got)])
        return total[first[1:]] - total[first[:-1]]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """Texts x thresholds: chance of a grade above each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def _ratio(part: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.minimum(9, (10 * part) // np.maximum(of, 1)).astype(np.uint64)


def features(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of rows with the distinct features of their whole texts, and bounds."""
    for rows, body, at in chunks(column):
        words, signs = split(body, at, NOT_WORD), split(body, at, NOT_SIGN, lower=False)
        h, s = words.hashes(), signs.hashes() ^ np.uint64(0x5157)
        n, m = words.counts(), signs.counts()
        along = lambda hit: np.add.reduceat(np.append(hit.astype(np.int64), 0), at[:-1]) * (np.diff(at) > 0)
        same = np.zeros(len(h) + 1, np.int64)
        same[1 : len(h)] = h[1:] == h[:-1]
        again = np.where(n > 0, np.add.reduceat(same, np.minimum(words.doc[:-1], len(h))), 0)
        ratios = [_ratio(along((body >= 65) & (body <= 90)), along(ALNUM[body])), _ratio(again, n), _ratio(along(~NOT_SIGN[body]), np.diff(at)), _ratio(m, n + m), np.minimum(9, np.log2(n + 1)).astype(np.uint64)]
        kinds = np.stack([mixed(r + np.uint64(1_000 + 16 * k)) for k, r in enumerate(ratios)], axis=1)
        seg = np.concatenate([words.doc_of(), signs.doc_of(), np.repeat(np.arange(len(n)), kinds.shape[1])])
        values = np.concatenate([h, s, kinds.ravel()])[np.argsort(seg, kind="stable")]
        yield rows, *distinct(values, np.concatenate([[0], np.cumsum(n + m + kinds.shape[1])]))


def fit(rows: list[np.ndarray], grades: np.ndarray, keys: np.ndarray, n_grades: int) -> OrdinalModel:
    """Adaptive-gradient descent over texts in a fixed shuffled order; deterministic. rows: places of a text's features in `keys`.

    Only a batch's own features move; the pull to zero of the steps between is caught up when a feature comes again.
    """
    share = np.array([(grades >= k).mean() if len(grades) else 0.5 for k in range(1, n_grades)])
    bars = -np.log(np.clip(share, 0.01, 0.99) / np.clip(1 - share, 0.01, 0.99)) + 1e-3 * np.arange(n_grades - 1)
    w, seen, rng = np.zeros(len(keys)), np.full(len(keys), 1e-6), np.random.default_rng(11)
    bar_seen, last, step = np.full(n_grades - 1, 1e-6), np.zeros(len(keys), np.int64), 0
    for _ in range(math.ceil(STEPS * BATCH / len(rows)) if rows else 0):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), BATCH):
            pick, step = order[low : low + BATCH], step + 1
            sizes = np.array([len(rows[i]) for i in pick])
            idx, doc = np.concatenate([rows[i] for i in pick]), np.repeat(np.arange(len(pick)), sizes)
            own, at = np.unique(idx, return_inverse=True)
            s, y = np.bincount(doc, w[idx], len(pick)), grades[pick]
            g, bar_grad = gradients(s, y, bars)
            grad = np.bincount(at, g[doc], len(own)) / len(pick) - PULL * np.minimum(step - last[own], 100) * w[own]
            seen[own] += grad**2
            w[own] += STEP * grad / np.sqrt(seen[own])
            last[own] = step
            bar_seen += bar_grad**2
            bars = np.maximum.accumulate(bars + STEP * bar_grad / np.sqrt(bar_seen))
    return OrdinalModel(keys, w.astype(np.float32), bars)


def gradients(score: np.ndarray, y: np.ndarray, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of log P(grade = y): by each text's score, and by each threshold (the mean over the texts)."""
    up = np.concatenate([np.ones((len(y), 1)), 1 / (1 + np.exp(np.clip(bars[None] - score[:, None], -50, 50))), np.zeros((len(y), 1))], axis=1)
    top, low = up[np.arange(len(y)), y], up[np.arange(len(y)), y + 1]
    # top and low are sigmoids of the score minus their thresholds
    gap = np.maximum(top - low, 1e-9)
    bar = [(np.where(y == k + 1, -top * (1 - top) / gap, 0) + np.where(y == k, low * (1 - low) / gap, 0)).mean() for k in range(len(bars))]
    return 1 - top - low, np.array(bar)


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE, most: int = SAMPLE_FEATURES) -> OrdinalModel:
    """ratings: doc_id, grade (0 to n_grades - 1; null: left out). Fits on at most `sample` rated documents, of `most` features in all.

    These are the ones of the least hashes of doc_id (ties: the smaller id); of a document's repeated ratings the least
    counts, and rows that share a rated id are each a text of the sample. Null texts are empty; long ones are read
    whole. Without ratings the model has no weights and even shares.
    """
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "grade")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(rated), F.col("doc_id") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values, first in features(batch.column(2)):
                got = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], got], names=["doc_id", "grade", "features"])

    found = written(rows.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, features array<long>"), "quality-features")
    if (found.agg(F.sum(F.size("features"))).first()[0] or 0) > most:
        sizes = found.select("doc_id", F.xxhash64("features").alias("_f"), F.size("features").cast("long").alias("_n"))
        taken = running(sizes, [], [F.xxhash64("doc_id").asc(), F.col("doc_id").asc(), F.col("_f").asc()], F.col("_n"), "_until").filter(F.col("_until") <= most)
        found = found.withColumn("_f", F.xxhash64("features")).join(taken.select("doc_id", "_f"), ["doc_id", "_f"], "left_semi").drop("_f")
        found = written(found, "quality-taken")
    often = found.select(F.explode("features").alias("key")).distinct().toArrow()
    keys = np.sort(often.column("key").to_numpy().view(np.uint64))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for x in batch.column(2):
                own = x.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                lists.append(at[keys[at] == own].astype(np.int32).tobytes() if len(keys) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.binary())], names=["doc_id", "grade", "places"])

    got = found.mapInArrow(placed, "doc_id long, grade int, places binary").toArrow()
    order, grades = np.argsort(got.column("doc_id").to_numpy(), kind="stable"), got.column("grade").to_numpy().astype(np.int64)
    places = [np.frombuffer(x.as_py(), np.int32) for x in got.column("places")]
    model = fit([places[i] for i in order], grades[order], keys, n_grades)
    got = often = places = None
    trimmed()
    return model


def rated(text: Column, model: OrdinalModel) -> Column:
    """struct<expected_grade double, p_top double> of a text column (null: the empty text)."""

    @F.arrow_udf("expected_grade double, p_top double")
    def run(column: pa.Array) -> pa.Array:
        tails = [np.zeros((0, len(model.thresholds)))]
        tails += [model.tails(model.scores(values, first)) for _, values, first in features(column)]
        all_ = np.concatenate(tails)
        return pa.StructArray.from_arrays([pa.array(all_.sum(axis=1)), pa.array(all_[:, -1])], names=["expected_grade", "p_top"])

    return run.asNondeterministic()(F.coalesce(text, F.lit("")))


def graded(labels: DataFrame) -> DataFrame:
    """0: toxic, 1: of low quality, 2: clean."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def classified(docs: DataFrame, model: OrdinalModel, keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade (0 to the top grade), p_top, keep (p_top >= `keep`, a tie stays), one row an input row.

    A null or empty text is scored as one without words, a long one as a whole; ids may be null or repeated, repeated
    rows get equal results, other columns are not read. An empty table gives an empty result.
    """
    got = docs.select("doc_id", rated(F.col("text"), model).alias("_r"))
    return got.select("doc_id", "_r.expected_grade", "_r.p_top", (F.col("_r.p_top") >= keep).alias("keep"))


def selected(docs: DataFrame, model: OrdinalModel, keep: float = KEEP) -> DataFrame:
    """The rows of `docs`, all columns, that are kept; as in `classified`."""
    free = "_" * (1 + max(map(len, docs.columns), default=0))  # a name that no column has
    return docs.withColumn(free, rated(F.col("text"), model)).filter(F.col(f"{free}.p_top") >= keep).drop(free)
