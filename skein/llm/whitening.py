"""Whitening of vectors on an integer grid: two passes for the covariance, LAPACK for its eigenvectors, then a projection.

The first pass sums integers exactly, so the mean has no rounding; the second sums outer products of centred vectors, a
matrix product a batch and a tree of partial sums over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Steps of the grid in 1, and what is added.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: A grid value lies below this in size; a vector with a larger entry has no integer form.
LARGEST = float(1 << 62)


def on_grid(column: str = "embedding") -> Column:
    """Not null, not empty, all entries finite and small enough for a long (never null)."""
    v = F.col(column)
    held = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < LARGEST))
    return F.coalesce(held & (F.size(v) > 0), F.lit(False))


def integers(batch: pa.Array, dim: int) -> np.ndarray:
    flat = batch.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), dim)


@dataclass
class Whitener:
    """n vectors with sums S; directions: dim x components, unit columns by falling variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    directions: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: of 64 bits, or Python's integers where those may not hold it."""
        most = max(int(np.abs(x).max(initial=0)), *(abs(s) // max(self.n, 1) + 1 for s in self.sums))
        if 2 * most * self.n < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def projected(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / np.sqrt(self.variances)


def squares(d: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    if d.dtype == object:
        return [int(v) for v in (d * d).sum(axis=1)]
    most, dim = int(np.abs(d).max(initial=0)), d.shape[1]
    if most * most * dim < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    if most >= 1 << 50 or dim > 1 << 12:
        return squares(d.astype(object))
    high, low = d >> 25, d & ((1 << 25) - 1)
    return [(a << 50) + (b << 26) + c for a, b, c in zip(*((p * q).sum(axis=1).tolist() for p, q in ((high, high), (high, low), (low, low))), strict=True)]


def _summed(rows: DataFrame, part, names: list[str]) -> list[np.ndarray] | None:
    """The sums over all tasks of the arrays that `part` gives for a task's batches; merged in a tree, None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = part(batch)
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in total] + [pa.array(["/".join(a.dtype.str for a in total)])], names=[*names, "kinds"])

    def read(row) -> list[np.ndarray]:
        return [np.frombuffer(b, k) for b, k in zip(row[:-1], row[-1].split("/"), strict=True)]

    def add(a, b):
        return b if a is None else a if b is None else [x + y for x, y in zip(a, b, strict=True)]

    found = rows.mapInArrow(run, ", ".join(f"{c} binary" for c in names) + ", kinds string")
    return found.rdd.treeAggregate(None, lambda a, row: add(a, read(row)), add)


def fitted(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Whitener | None:
    """fit: x array<long>, all of length dim, a row for each vector that counts. None without rows."""

    def totals(batch: pa.RecordBatch) -> list[np.ndarray]:
        x = integers(batch.column(0), dim)  # in halves, so that no sum overflows
        return [np.array([len(x)]), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]

    first = _summed(fit, totals, ["n", "high", "low"])
    if first is None:
        return None
    n, sums = int(first[0][0]), [(int(h) << 32) + int(low) for h, low in zip(first[1], first[2], strict=True)]
    known = Whitener(n, sums, np.ones(0), np.zeros((dim, 0)), np.zeros(0))

    def outer(batch: pa.RecordBatch) -> list[np.ndarray]:
        d = known.centred(integers(batch.column(0), dim))
        return [(d.T @ d).ravel()]

    covariance = _summed(fit, outer, ["products"])[0].reshape(dim, dim) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = np.flatnonzero(values > max(values[0], 0) * dim * np.finfo(float).eps)[:components]
    vectors = vectors[:, some]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(some))]
    return Whitener(n, sums, values[some], vectors * np.where(lead < 0, -1.0, 1.0), values[some] / np.trace(covariance) if len(some) else np.zeros(0))


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """The largest entry in size of the fit list's covariance after whitening, less the identity; measured on the rows."""
    k = len(model.variances)

    def outer(batch: pa.RecordBatch) -> list[np.ndarray]:
        w = model.projected(integers(batch.column(0), len(model.sums)))
        return [(w.T @ w).ravel()]

    return float(np.abs(_summed(fit, outer, ["products"])[0].reshape(k, k) / model.n - np.eye(k)).max(initial=0.0))


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """rows: vec_id, embedding (array of numbers); other columns are not read. A row for each vector and component.

    vec_id, component (from 1), n (different vectors on the grid), deviation (sum over dimensions of (n*x - S)^2, exact, a
    decimal(38, 0), null beyond it), whitened, explained (share of the variance), identity_error. Vectors that are null,
    empty, hold a null, an entry that isn't finite or one beyond 2**56, and those of another length than most (of ties the
    greater) are left out. Repeated vectors and rows all get results but count once in the fit. A direction without
    variance can't be whitened: there are as many components as the fit list has dimensions, none for a single vector. An
    empty table gives an empty result. The driver and each task hold dim x dim numbers.
    """
    rows = rows.select("vec_id", "embedding").filter(on_grid())
    dim = int(rows.groupBy(F.size("embedding").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"]).first()[0] or 0)
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    grid = rows.filter(F.size("embedding") == dim).select("vec_id", x.alias("x"))
    fit = written(grid.select("x").distinct(), "whitening-fit")
    model = fitted(fit, dim, components)
    k = len(model.variances) if model else 0
    error = identity_error(fit, model) if k else 0.0
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if not k or not len(batch):
                continue
            values = integers(batch.column(1), dim)
            each = np.repeat(np.arange(len(batch)), k)
            size = pa.array([Decimal(s) if s < 10**38 else None for s in squares(own.deviations(values))], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array(np.full(len(each), own.n)), size.take(pa.array(each)),
                    pa.array(own.projected(values).ravel()), pa.array(np.tile(own.explained, len(batch))), pa.array(np.full(len(each), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = dict(grid.dtypes)["vec_id"]
    return grid.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
