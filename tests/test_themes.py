"""Generic themes by blocks against all pairs."""

import numpy as np
import pytest

from skein.operators import search


def plain(rows):
    x = np.array([v for *_, v in rows])
    x = x - x.mean(axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s, corpora = x @ x.T, np.array([c for c, *_ in rows])
    names = sorted(set(corpora))
    out = {}
    for i, (c, t, _) in enumerate(rows):
        share = np.mean([s[i][corpora == o].max() >= 0.5 for o in names if o != c])
        out[c, t] = (round(share, 9), bool(share >= 0.6 and len(names) >= 5))
    return out


def themes(rng, corpora, each, groups, spread, dim=24):
    centres = rng.normal(size=(groups, dim))
    return [(f"c{c}", t, [float(v) for v in centres[rng.integers(groups)] + spread * rng.normal(size=dim)]) for c in range(corpora) for t in range(each)]


@pytest.mark.parametrize(("corpora", "each", "groups", "spread", "block"), [(12, 30, 40, 0.15, 25), (12, 30, 40, 0.15, 5000), (4, 20, 5, 0.3, 10), (6, 40, 3, 2.0, 30), (1, 10, 2, 0.1, 5), (7, 1, 2, 0.3, 1)])
def test_equals_all_pairs(spark, corpora, each, groups, spread, block):
    rows = themes(np.random.default_rng(corpora + block), corpora, each, groups, spread)
    got = search.generic_themes(spark.createDataFrame(rows, "corpus string, theme long, embedding array<double>"), block).collect()
    want = plain(rows) if corpora > 1 else {}
    assert {(r.corpus, r.theme): (round(r.share, 9), r.generic) for r in got} == want


def test_few_pairs_of_blocks_are_compared(spark):
    rng = np.random.default_rng(9)
    rows = themes(rng, 20, 100, 60, 0.15, dim=64)
    x = np.array([v for *_, v in rows])
    x = x - x.mean(axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    unit = spark.createDataFrame([(c, t, [float(a) for a in v]) for (c, t, _), v in zip(rows, x, strict=True)], "corpus string, theme long, v array<double>")
    own, pairs = search.theme_blocks(unit, 20)
    blocks = own.select("block").distinct().count()
    assert blocks >= 60 and own.count() == 2000
    assert pairs.count() < 0.2 * blocks * (blocks + 1) / 2
