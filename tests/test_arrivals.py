"""Conversations under late arrivals: any order and batching ends as all messages at once."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import threads
from skein.streaming import threads as kept

SCHEMA = "corpus string, message_id string, subject string, date timestamp, in_reply_to string, references array<string>, path string"


def mail(rng, n):
    """Trees under few subjects, with parents that may be missing, cycles, copies, and replies that only share a subject."""
    rows = []
    for i in range(n):
        subject = str(rng.choice(["plan", "draft", "vote", ""])) + str(rng.choice(["", " b"]))
        known = [f"m{int(k)}" for k in rng.integers(0, n + 5, int(rng.integers(0, 3)))]
        reply = f"m{int(rng.integers(0, n + 5))}" if rng.random() < 0.4 else None
        date = None if rng.random() < 0.05 else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=int(rng.integers(0, 500)))
        rows.append((str(rng.choice(["c", "d"])), f"m{i}", ("Re: " if rng.random() < 0.7 else "") + subject, date, reply, known, f"p{int(rng.integers(0, 99)):02d}-{i}"))
    return rows + [(*r[:4], None, [], f"a-{r[1]}") for r in rows[:5]]


def facts(df):
    return {(r.message_id, r.parent_id, r.thread, r.corpus, r.place) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    rows = mail(rng, 60)
    want = facts(threads.assembled(spark.createDataFrame(rows, SCHEMA)))
    order = [rows[i] for i in rng.permutation(len(rows))]
    bounds = sorted({0, len(order), *rng.integers(1, len(order), 4).tolist()})
    path = str(tmp_path / "store")
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        kept.arrive(spark.createDataFrame(order[low:high], SCHEMA), path, buckets=7)
    assert facts(kept.conversations(spark, path)) == want
    kept.arrive(spark.createDataFrame(order[-3:], SCHEMA), path)  # the same again
    assert facts(kept.conversations(spark, path)) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [("c", f"r{k}", f"subject {k}", at(1), None, [], f"{k}") for k in range(200)]
    path = str(tmp_path / "store")
    assert len(kept.arrive(spark.createDataFrame(rows, SCHEMA), path, buckets=50)) > 40
    late = [("c", "x", "Re: subject 7", at(3), "r7", [], "x")]
    assert len(kept.arrive(spark.createDataFrame(late, SCHEMA), path)) == 2  # that of the subject, and of those without a root
    got = {r.message_id: (r.parent_id, r.thread) for r in kept.conversations(spark, path).filter("thread = 'r7'").collect()}
    assert got == {"r7": (None, "r7"), "x": ("r7", "r7")}
    kept.arrive(spark.createDataFrame([("c", "y", "another", at(2), None, [], "y"), ("c", "r7", "subject 7", at(1), "y", [], "0")], SCHEMA), path)  # a late parent takes the root below it
    got = {r.message_id: (r.parent_id, r.thread) for r in kept.conversations(spark, path).filter("thread = 'y'").collect()}
    assert got == {"y": (None, "y"), "r7": ("y", "y"), "x": ("r7", "y")}
    assert kept.conversations(spark, path).count() == 202


def test_as_a_stream(spark, tmp_path):
    rows = mail(np.random.default_rng(5), 30)
    for k, part in enumerate((rows[20:], rows[:20])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    for k in (0, 1):
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / f"in/{k}"))
        kept.kept(stream, str(tmp_path / "store"), str(tmp_path / f"check{k}"), buckets=5).awaitTermination()
    assert facts(kept.conversations(spark, str(tmp_path / "store"))) == facts(threads.assembled(spark.createDataFrame(rows, SCHEMA)))
    assert kept._stored(spark, str(tmp_path / "store")).select(F.count_distinct("message_id")).first()[0] == 30
