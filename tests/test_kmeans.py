"""Clusters of many corpora against a plain mini-batch version, on any number of partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import catalogue
from skein.operators import kmeans, topics

SF = "/root/testdata/sf0.001"


def plain(x, k, seed=1729, epochs=10, batch=256):
    """Spherical mini-batch k-means in one process: far-apart seeds, empty clusters take the worst-placed vector."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        far = np.maximum(0, 1 - np.max(x @ np.array(centres).T, axis=1))
        centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
    c, seen = np.array(centres), np.zeros(k)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), batch):
            part = x[order[low : low + batch]]
            own = (part @ c.T).argmax(axis=1)
            for j in np.unique(own):
                seen[j] += (own == j).sum()
                c[j] += (part[own == j].mean(axis=0) - c[j]) * (own == j).sum() / seen[j]
                c[j] /= max(np.linalg.norm(c[j]), 1e-12)
        score = x @ c.T
        for j in np.setdiff1d(np.arange(k), score.argmax(axis=1)):
            c[j] = x[score.max(axis=1).argmin()]
    return (x @ c.T).argmax(axis=1)


def objective(x, own):
    """Sum of cosines with the best centre of each cluster."""
    return sum(np.linalg.norm(x[own == j].sum(axis=0)) for j in np.unique(own))


@pytest.fixture(scope="module")
def corpora(spark):
    rng = np.random.default_rng(5)
    out = {}
    for name, n, groups, spread in (("hot", 3000, 20, 0.25), ("loose", 700, 12, 0.8), ("small", 60, 4, 0.1), ("noise", 400, 1, 5.0), ("tiny", 5, 2, 0.1)):
        x = rng.normal(size=(groups, 16))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 16))
        out[name] = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(c, i, [float(a) for a in v]) for c, x in out.items() for i, v in enumerate(x)] + [("hot", 9999, None), (None, 1, [1.0] * 16)]
    return out, spark.createDataFrame(rows, "corpus string, id long, embedding array<double>")


def labels(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.corpus, {})[r.id] = r.cluster
    return {c: np.array([own[i] for i in sorted(own)]) for c, own in out.items()}


@pytest.fixture(scope="module")
def found(corpora):
    return labels(topics.clustered(corpora[1].repartition(1)))


def test_as_good_as_the_plain_version(corpora, found):
    x, _ = corpora
    assert set(found) == {"hot", "loose", "small", "noise"}
    for name, own in found.items():
        n = len(x[name])
        k = int(min(32, max(4, np.rint(np.sqrt(n / 2)))))
        assert len(own) == n and set(own) == set(range(k))
        sizes = np.bincount(own)
        assert (np.diff(sizes) <= 0).all()
        assert objective(x[name], own) >= 0.98 * max(objective(x[name], plain(x[name], k, seed)) for seed in range(3))


@pytest.mark.parametrize("parts", [3, 17])
def test_equal_on_any_number_of_partitions(spark, corpora, found, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = labels(topics.clustered(corpora[1].orderBy(F.rand(parts)).repartition(parts)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.keys() == found.keys() and all((got[c] == found[c]).all() for c in got)


def test_waves_and_few_different_vectors(spark, monkeypatch):
    rows = [(c, i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)]) for c in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "corpus int, id long, embedding array<double>")
    one = labels(topics.clustered(df))
    monkeypatch.setattr(kmeans, "WAVE_NUMBERS", 30)
    many = labels(topics.clustered(df))
    for c in range(6):
        assert len(set(one[c])) == 3 and all(len(set(one[c][k::3])) == 1 for k in range(3))
        assert len(set(many[c])) == 3


def test_an_empty_cluster_takes_the_worst_placed(spark):
    x = np.eye(4)[[0, 0, 0, 1, 1, 2]] + 0.0
    table = kmeans.gridded(spark.createDataFrame([("c", i, [float(a) for a in v]) for i, v in enumerate(x)], "corpus string, id long, embedding array<double>"))
    centres = {"c": np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1.0]]) * kmeans.GRID}
    kmeans._repaired(table, centres, {"c": [2]}, "string")
    assert (centres["c"][2] == np.array([0, 0, 1, 0]) * kmeans.GRID).all()


def test_topic_map_is_as_good_as_the_plain_version(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("label") % 3, "vec_id", "embedding").collect()
    own = labels(catalogue.QUERIES["topic_map"](spark, SF))
    for c in {r[0] for r in e}:
        x = np.array([r.embedding for r in sorted((r for r in e if r[0] == c), key=lambda r: r.vec_id)], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert objective(x, own[c]) >= 0.98 * objective(x, plain(x, own[c].max() + 1))


def test_topic_records_describe_every_document(spark):
    out = catalogue.QUERIES["topic_records"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r["size"] for r in out) == docs
    for r in out:
        assert r.terms is None or len(r.terms) <= 6 and r.label == ", ".join(r.terms[:3])
        assert 1 <= len(r.exemplars) <= 3
