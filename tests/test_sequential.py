"""Distributed versions of rules that are stated in order, against a walk in that order."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import catalogue
from skein.operators import people, ranks, threads

DAY = 86_400
SF = "/root/testdata/sf0.001"


@pytest.fixture(params=[1 << 18, 0], ids=["few", "many"])
def many(request, monkeypatch, spark):
    """Also with every rank dealt by ranges, over more partitions than rows of most keys."""
    monkeypatch.setattr(ranks, "FEW_ROWS", request.param)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def merged(rows, days=60):
    """The greedy rule for one subject: id to thread. rows: (id, reply, date, last) in days or None."""
    clusters, owner = [], {}
    for i, reply, date, last in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        target = None
        if reply:
            target = next((c for c in reversed(clusters) if date is None or c[1] is None or date - c[1] <= days), None)
        if target is None:
            target = [i, last]
            clusters.append(target)
        elif last is not None and (target[1] is None or last > target[1]):
            target[1] = last
        owner[i] = target[0]
    return owner


def roots(spark, subjects):
    at = lambda d: None if d is None else datetime.datetime(2000, 1, 1) + datetime.timedelta(days=d)
    rows = [("c", key, i, ("Re: " if reply else "") + key, at(date), at(last)) for key, own in subjects.items() for i, reply, date, last in own]
    return spark.createDataFrame(rows, "corpus string, key string, id long, subject string, date timestamp, last timestamp")


def test_subject_merge(spark, many):
    rng = np.random.default_rng(11)
    subjects, n = {}, 0
    for k in range(40):
        own = []
        size = 400 if k == 0 else int(rng.integers(1, 40))  # one subject has a third of all
        share, span, long = float(rng.choice([0.3, 0.8, 0.97, 1.0])), int(rng.choice([200, 2000, 9000])), float(rng.choice([5, 100, 700]))
        for _ in range(size):
            date = None if rng.random() < 0.05 else int(rng.integers(0, span))
            last = None if date is None else date + int(rng.exponential(long) * (rng.random() < 0.3))
            own.append((n, bool(rng.random() < share), date, last))
            n += 1
        subjects[f"s{k}"] = own
    subjects["undated replies"] = [(n, True, None, None), (n + 1, True, None, None), (n + 2, False, None, None), (n + 3, True, None, None)]
    subjects["replies only"] = [(n + 10 + i, True, i * 50, i * 50) for i in range(60)]
    subjects["nested"] = [(n + 100, False, 0, 5000), *((n + 101 + i, i % 3 == 0, 10 + 70 * i, 10 + 70 * i) for i in range(60))]
    want = {}
    for own in subjects.values():
        want |= merged(own)
    got = threads.subject_clusters(roots(spark, subjects)).collect()
    assert len(got) == len(want) and {r.id: r.thread for r in got} == want
    assert threads.subject_clusters(roots(spark, subjects).limit(0)).count() == 0


def test_registered_subjects(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate").collect()
    want, by = {}, {}
    for r in o:
        day = (datetime.date.fromisoformat(str(r.o_orderdate)[:10]) - datetime.date(1970, 1, 1)).days
        by.setdefault(r.o_custkey, []).append((r.o_orderkey, r.o_orderkey % 3 > 0, day, day))
    for own in by.values():
        want |= merged(own)
    assert {r.id: r.thread for r in catalogue.QUERIES["subject_threads"](spark, SF).collect()} == want


def owned(rows):
    """The sequential rule: seq to person. rows: (seq, email, key)."""
    by_mail, by_key, who = {}, {}, {}
    for seq, email, key in sorted(rows):
        person = by_mail.get(email) if email else None
        if person is None and key:
            person = by_key.get(key)
        person = seq if person is None else person
        if email:
            by_mail[email] = person
        if key:
            by_key[key] = person
        who[seq] = person
    return who


def test_senders_in_order(spark, many):
    """Owners of names change hands, addresses keep theirs; some have only a name, and one name has a third of all."""
    rng = np.random.default_rng(12)
    corpora = {}
    for c in range(4):
        pick = lambda kinds, hot, n: [None if x < 0.1 else "" if x < 0.15 else f"{kinds}0" if x < 0.15 + hot else f"{kinds}{rng.integers(1, 40)}" for x in rng.random(n)]
        corpora[f"c{c}"] = list(zip(range(300), pick("m", 0.1, 300), pick("k", 0.33, 300), strict=True))
    corpora["chain"] = [(i, f"m{i}", f"k{i}") if i % 2 == 0 else (i, f"m{i - 1}", f"k{i + 1}") for i in range(400)]
    want = set()
    for c, rows in corpora.items():
        who = owned(rows)
        want |= {(c, e or None, k or None, who[s]) for s, e, k in rows if e or k}
    df = spark.createDataFrame([(c, *r) for c, rows in corpora.items() for r in rows], "corpus string, seq long, email string, key string")
    got = people.ingested(df).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert len({p for c, *_, p in want if c == "chain"}) == 1


def test_ranks_of_ranges(spark, many):
    rng = np.random.default_rng(13)
    rows = [(None if k == 3 else int(k), i, int(v)) for i, (k, v) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 200), rng.integers(0, 50, 200), strict=True))]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    running, highest, previous = {}, {}, {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for n, (_, i, v) in enumerate(own):
            running[i], highest[i], previous[i] = sum(r[2] for r in own[: n + 1]), max((r[2] for r in own[:n]), default=None), own[n - 1][2] if n else None
    order = [F.col("i").asc()]
    assert {r.i: r.x for r in ranks.running(df, ["k"], order, F.col("v"), "x").collect()} == running
    assert {r.i: r.x for r in ranks.highest(df, ["k"], order, "v", "x").collect()} == highest
    assert {r.i: r.x for r in ranks.previous(df, ["k"], ["i"], "v", "x").collect()} == previous
    assert {r.i: r.place for r in ranks.placed(df, [], [F.desc("i")]).collect()} == {r[1]: 200 - r[1] for r in rows}


def test_subject_ranges_are_scanned_as_a_stream():
    """Wherever batches end, ranges give the same rows; the date before a range decides whether its first reply founds."""
    import pyarrow as pa

    from skein.operators import threads

    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    names = ["corpus", "key", "_p", "d", "id", "z", "reply", "_before"]
    data = [("c", "a", 0, 1, 1, 4, False, None), ("c", "a", 0, 5, 2, 5, True, None), ("c", "a", 1, None, None, None, None, 5), ("c", "a", 1, 9, 3, 9, True, None), ("c", "a", 1, 40, 4, 40, True, None), ("c", "b", 1, 41, 5, 41, True, None)]
    schema = pa.schema([("corpus", pa.string()), ("key", pa.string()), ("_p", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("owner", pa.int64()), ("n", pa.int32()), ("d", pa.int64()), ("z", pa.int64())])
    want = [(0, 1, 1, None), (0, 2, 1, None), (1, 1, 1, 0), (0, 3, None, 0), (0, 4, 4, None), (1, 4, 4, 0), (2, 3, None, 0), (0, 5, 5, None), (1, 5, 5, 0)]
    for size in (1, 2, 6):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*data[k : k + size], strict=True), types, strict=True)], names=names) for k in range(0, len(data), size)]
        got = [r for b in threads._scanned(iter(parts), 10, schema) for r in b.to_pylist()]
        assert [(r["kind"], r["id"], r["owner"], r["n"]) for r in got] == want
