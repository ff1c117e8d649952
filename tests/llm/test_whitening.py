"""Whitening against numpy on exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from skein.llm import whitening
from skein.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, components=16):
    """{(vec_id, deviation)} and, for the fit list, eigenvalues, share and directions."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    dims = [len(v) for _, v in good]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    grid = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in good if len(v) == dim]
    fit = sorted({tuple(x) for _, x in grid})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return grid, n, sums, values[::-1], vectors[:, ::-1]


def checked(got, rows, components=16):
    grid, n, sums, values, vectors = plain(rows)
    some = min(components, int((values > values[0] * 1e-12).sum()))
    assert len(got) == len(grid) * some and set(got.n) == {n}
    assert (got.identity_error < 1e-4).all() and got.identity_error.nunique() == 1
    size = {}
    for i, x in grid:
        size.setdefault(i, set()).add(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
    assert all(int(r.deviation) in size[None if r.vec_id != r.vec_id else r.vec_id] for r in got.itertuples())
    want = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for _, x in grid]) @ vectors[:, :some] / np.sqrt(values[:some])
    ids = [i for i, _ in grid]
    for c in range(some):
        own = got[got.component == c + 1]
        assert np.allclose(own.explained, values[c] / values.sum(), rtol=1e-8)
        once = [k for k, i in enumerate(ids) if i is not None and ids.count(i) == 1]
        found = own[own.vec_id.isin([ids[k] for k in once])].set_index("vec_id").whitened.loc[[ids[k] for k in once]].to_numpy()
        sign = 1 if found @ want[once, c] > 0 else -1
        assert np.allclose(sign * found, want[once, c], atol=1e-6)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(8, 8)) * np.array([9, 7, 5, 4, 3, 2, 1, 0.5])
    out = [(i, [float(x) for x in np.float32(rng.normal(size=8) @ mix)]) for i in range(300)]
    out += [(i + 1000, out[i][1]) for i in range(50)] + [(2000 + i, out[0][1]) for i in range(200)]
    return out + [(3000, None), (3001, []), (3002, [1.0] * 7 + [None]), (3003, [1.0] * 7 + [math.nan]), (3004, [math.inf] + [1.0] * 7), (3005, [1.0] * 9), (None, [0.5] * 8), (7, [0.25] * 8), (7, [0.0] * 8)]


@pytest.mark.parametrize("components", [16, 3])
def test_equals_numpy(spark, rows, components):
    df = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "vec_id long, embedding array<float>, n int, x double").repartition(6)
    checked(whitening.whitened(df, components).toPandas(), rows, components)
    assert whitening.whitened(df.limit(0)).count() == 0


def test_large_offset_and_numbers(spark, rows):
    """An offset far above the spread, and sums of squares beyond 64 bits, stay exact."""
    far = [(i, [c + 1e9 * (k + 1) for k, c in enumerate(v)]) for i, v in rows if v and len(v) == 8 and None not in v]
    checked(whitening.whitened(spark.createDataFrame(far, "vec_id long, embedding array<double>")).toPandas(), far)
    wide = [(i, [c * 3e7 for c in v]) for i, v in rows if v and len(v) == 8 and None not in v]
    got = whitening.whitened(spark.createDataFrame(wide, "vec_id long, embedding array<double>"))
    assert got.filter("deviation > 9223372036854775807").count() > 0
    checked(got.toPandas(), wide)


def test_beyond_the_grid_one_vector_and_flat_directions(spark):
    rows = [(1, [1e30, 0.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0])]
    make = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    assert whitening.whitened(make(rows)).count() == 0
    got = whitening.whitened(make([*rows, (4, [3.0, 2.0])])).toPandas()
    assert set(got.vec_id) == {2, 3, 4} and set(got.component) == {1} and np.allclose(got.explained, 1) and np.allclose(sorted(got.whitened.abs()), 1)


def test_sums_of_squares():
    for top in (1 << 20, 1 << 40, 1 << 55):
        d = np.random.default_rng(1).integers(-top, top, (9, 5))
        assert whitening.squares(d) == whitening.squares(d.astype(object)) == [sum(int(v) ** 2 for v in r) for r in d]


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op13_whitening"](spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    checked(got.toPandas(), rows)
