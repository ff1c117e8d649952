"""Removal of repeated windows against a plain version, with blocks, cells and pieces made small."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import windows
from skein.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, size=13):
    """[(n_words, n_removed, sha256)] of (doc_id, text) rows."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    last = max((i for i, _ in rows if i is not None), default=0) + 1
    order = [last if i is None else i for i, _ in rows]
    least = {}
    for o, w in zip(order, texts, strict=True):
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, o), o)
    out = []
    for o, w in zip(order, texts, strict=True):
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < o:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def got(df, **settings):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in windows.deduplicated(df, windows.Settings(**settings)).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    prose = lambda n, k=3000: " ".join(f"w{i}" for i in rng.integers(0, k, n))
    passage, long = prose(60), prose(20_000)
    base = prose(200)
    out = [
        (50, base), (3, base), (7, base + " tail"), (9, "head " + base), (11, passage), (12, f"{prose(30)}\t{passage}\n\n{prose(30)}"), (13, passage.replace(" ", "  \x0b")), (14, passage.upper()),
        (20, None), (21, ""), (22, " \n\t "), (23, "one two"), (24, prose(12)), (None, base), (None, base), (None, prose(40)), (None, None), (30, prose(50)), (30, prose(50)), (31, passage), (31, passage),
        (40, long), (41, long + " more"), (42, prose(100) + " " + long[5000:9000]), (60, "again " * 5000), (61, "again " * 40), (62, "\xa0ü 日本 " * 30), (63, "日本 \xa0ü " * 30), (-5, passage[10:]), (64, prose(400, 2)), (65, prose(400, 2)),
    ]
    return out + [(100 + i, f"{prose(15)} {passage} {prose(15)}") for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.select("*", *(F.lit("clash").alias(c) for c in ("twin", "id", "ranges", "start", "n", "bucket", "packed", "cell")))


@pytest.fixture(scope="module")
def want(rows):
    return Counter((i, *x) for (i, _), x in zip(rows, plain(rows), strict=True))


def test_equals_plain(docs, want):
    assert got(docs) == want
    assert got(docs.limit(0)) == Counter()


def test_large_cells_travel_singly(docs, want):
    assert got(docs, large=1) == want


def test_small_blocks_buckets_and_parts(docs, want):
    """Every text a block, every bucket in parts; nothing may be lost between them."""
    assert got(docs, block=200, longest=20, bucket=1 << 12) == want
    assert got(docs, block=5000, bucket=50) == want
    assert got(docs, block=200, bucket=50, large=1) == want
    assert got(docs, packed=100) == want


def test_equal_hashes_of_different_windows(monkeypatch):
    monkeypatch.setattr(windows, "rolled", lambda values, start, size: np.zeros(len(start), np.uint64))
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 2])
    at, group = windows.repeated(ids, np.arange(7), 3)
    same = {(int(a), int(b)) for a, g in zip(at, group, strict=True) for b, h in zip(at, group, strict=True) if g == h}
    assert {(i, j) for i in range(7) for j in range(7) if i != j and (ids[i : i + 3] == ids[j : j + 3]).all()} == {(i, j) for i, j in same if i != j}
    assert windows.earlier(ids, np.arange(7), 3, np.array([5, 5, 5, 4, 6, 6, 6])).tolist() == [True, False, False, False, True, True, False]


def test_consecutive_windows_travel_together(rows):
    """Parcels hold whole super-k-mers: every window once, a few thousand strings for twenty thousand windows."""
    long = next(t for i, t in rows if i == 40)
    table = pa.table({"doc_id": pa.array([1]), "twin": pa.array([1]), "text": pa.array([long])})
    (batch,) = windows.travelling(table, np.zeros(0, np.uint64), 50, 16, windows.Settings())
    assert len(batch) == 16 and sum(batch["windows"].to_pylist()) == 20_000 - 12
    sent = pa.Table.from_batches([windows.unpacked(r["size"], r["parcel"], windows.schema_of(pa.int64())) for r in batch.to_pylist()])
    assert len(sent) < 4500 and sorted(s + k for s, n in zip(sent["start"].to_pylist(), sent["n"].to_pylist(), strict=True) for k in range(n)) == list(range(20_000 - 12))
    words = long.split()
    assert all(p == " ".join(words[s : s + n + 12]) for p, s, n in zip(sent["packed"].to_pylist(), sent["start"].to_pylist(), sent["n"].to_pylist(), strict=True))


def test_query_equals_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((i, *x) for (i, _), x in zip(docs, plain(docs), strict=True))
    assert Counter(tuple(r) for r in QUERIES["op11_substring_dedup"](spark, SF).collect()) == want
    assert sum(x[2] for x in want) > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert Counter(con.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({ORACLES['op11_substring_dedup']})").fetchall()) == want
