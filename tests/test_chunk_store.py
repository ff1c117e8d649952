"""The chunk index: what an update rewrites, and that it ends as a full build does."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import chunking
from skein.sources import chunk_store


def chunker(df):
    return chunking.windows(df, window=8, overlap=2).select("file", F.lit(0).alias("chunk_idx"), "sub_idx", F.col("window").alias("embed_text"))


embed = lambda texts: [[float(len(t)), float(sum(map(ord, t)))] for t in texts]  # noqa: E731  (a lambda goes to the workers by value)


def files(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "relpath string, text string").withColumn("sha256", F.sha2("text", 256))


def state(spark, path):
    rows = chunk_store.chunks(spark, path).select("file", "sub_idx", "embed_text", "embedding").collect()
    return {(r.file, r.sub_idx, r.embed_text, tuple(r.embedding) if r.embedding else None) for r in rows}, {(r.file, r.stamp) for r in chunk_store.stamps(spark, path).collect()}


def parts(path):
    return {d: {f: os.stat(os.path.join(path, d, f)).st_mtime_ns for f in os.listdir(os.path.join(path, d))} for d in os.listdir(path) if d.startswith("bucket=")}


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(6)
    return {f"f/{k}.txt": "".join(rng.choice(list("abcdef "), int(rng.integers(0, 40)))) for k in range(1000)}


def test_one_changed_file_rewrites_one_bucket(spark, texts, tmp_path):
    path = str(tmp_path / "i")
    assert chunk_store.update(spark, path, files(spark, texts), chunker, embed, buckets=16) == list(range(16))
    before = parts(path)
    assert len(before) == 16 and chunk_store.update(spark, path, files(spark, texts), chunker, embed) == [] and parts(path) == before
    more = texts | {"f/7.txt": "quite another text"}
    (bucket,) = chunk_store.update(spark, path, files(spark, more), chunker, embed)
    after = parts(path)
    assert [d for d in after if after[d] != before[d]] == [f"bucket={bucket}"]
    chunk_store.update(spark, str(tmp_path / "full"), files(spark, more), chunker, embed, buckets=16)
    assert state(spark, path) == state(spark, str(tmp_path / "full"))


def test_additions_orphans_and_emptied_buckets(spark, texts, tmp_path):
    path, few = str(tmp_path / "i"), dict(list(texts.items())[:6])
    chunk_store.update(spark, path, files(spark, few), chunker, embed, buckets=64)
    left = dict(list(few.items())[:2]) | {"new": "a new one", "void": ""}
    chunk_store.update(spark, path, files(spark, left), chunker, embed)
    chunk_store.update(spark, str(tmp_path / "full"), files(spark, left), chunker, embed, buckets=64)
    assert state(spark, path) == state(spark, str(tmp_path / "full")) and {f for f, _ in state(spark, path)[1]} == set(left)
    chunk_store.update(spark, path, files(spark, {"x": "y"}), chunker, embed)
    chunk_store.update(spark, path, files(spark, {"x": "y"}).limit(0), chunker, embed)
    assert state(spark, path) == (set(), set())


def test_a_failed_embedding_is_tried_again(spark, tmp_path):
    path, texts = str(tmp_path / "i"), {"a": "good text here", "b": "bad words here", "c": "other"}
    chunk_store.update(spark, path, files(spark, texts), chunker, lambda t: [None if "bad" in x else v for x, v in zip(t, embed(t), strict=True)], buckets=4)
    assert {f for f, s in state(spark, path)[1] if s is None} == {"b"}

    def only_bad(t):
        assert all("bad" in x for x in t), t  # vectors that are there are not made again
        return embed(t)

    assert len(chunk_store.update(spark, path, files(spark, texts), chunker, only_bad)) == 1
    chunk_store.update(spark, str(tmp_path / "full"), files(spark, texts), chunker, embed, buckets=4)
    assert state(spark, path) == state(spark, str(tmp_path / "full"))


def test_another_chunker_keeps_vectors_and_another_model_none(spark, tmp_path):
    path, texts = str(tmp_path / "i"), {"a": "good text here", "b": "short"}

    def refuse(t):
        raise AssertionError(t)

    wide = lambda df: chunking.windows(df, window=8, overlap=2).select("file", F.lit(3).alias("chunk_idx"), "sub_idx", F.col("window").alias("embed_text"))
    chunk_store.update(spark, path, files(spark, texts), chunker, embed, "m", "1", buckets=4)
    assert chunk_store.update(spark, path, files(spark, texts), wide, refuse, "m", "2")
    assert {r.chunk_idx for r in chunk_store.chunks(spark, path).collect()} == {3}
    assert chunk_store.update(spark, path, files(spark, texts), wide, lambda t: [[0.0] for _ in t], "n", "2")
    assert {(r.model, tuple(r.embedding)) for r in chunk_store.chunks(spark, path).collect()} == {("n", (0.0,))}
