"""Filter counts against a walk over the documents, in every order; also against SQL."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from skein.llm import audit
from skein.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    last = max((i for i, *_ in rows if i is not None), default=0) + 1
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", last), last if i is None else i)
    facts = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": (last if i is None else i) > least[t]}
        facts.append((s or "", {f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = [], Counter()
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                shapley[part, name] += len(gone)
                fails = [f for f in own if name in f[1]]
                out.append((part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), sum(f[1] == {name} for f in fails), sum(f[2] for f in gone), sum(f[3] for f in gone)))
    return {(*x, shapley[x[0], x[1][x[2] - 1]]) for x in out}


def test_equals_walk(spark):
    rng = np.random.default_rng(3)
    word = lambda k: f"w{rng.integers(k)}"
    text = lambda: " ".join(word(int(rng.choice([5, 5000]))) for _ in range(int(rng.choice([20, 250])))) + str(rng.choice(["", " A$", " SHOUT" * 30, "#"]))
    pool = [text() for _ in range(25)] + [None, "", " \n ", "Ünï CODE 日本", "A\x0bA\x0cA A", "x" * 40_000, "one " * 30_000]
    rows = [(int(rng.integers(60)) if k % 7 else None, pool[int(rng.integers(len(pool)))], [None, "", "a", "b"][int(rng.integers(4))]) for k in range(150)]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 60, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit("clash").alias(c) for c in ("part", "mask", "key", "n", "good", "toxic", "words", "first")))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, said)
    assert got.columns == COLUMNS
    assert {tuple(r) for r in got.collect()} == plain(rows, labels)
    assert audit.audit(docs.limit(0), said).count() == 0
    assert {tuple(r) for r in audit.audit(docs, said.limit(0)).collect()} == plain(rows, [])


def test_polynomial_with_other_filters():
    """Three filters: shares add up to all that goes, corners are unions."""
    counts = np.array([[5, 1, 2, 3, 4, 0, 6, 7], [0, 0, 0, 0, 0, 0, 0, 0]])
    r = audit.Removal(counts)
    for mask in range(8):
        assert r.corners[0, mask] == sum(n for m, n in enumerate(counts[0]) if m & mask)
    shares = [r.shapley(i) for i in range(3)]
    assert sum(s[0] for s in shares) == 6 * (counts[0].sum() - 5) and all(s[1] == 0 for s in shares)
    for i in range(3):
        walked = sum(r.corners[0, sum(1 << j for j in p[: p.index(i) + 1])] - r.corners[0, sum(1 << j for j in p[: p.index(i)])] for p in permutations(range(3)))
        assert shares[i][0] == walked


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES["op12_filter_audit"]).df()[COLUMNS]
    got = QUERIES["op12_filter_audit"](spark, SF).toPandas()[COLUMNS]
    assert len(got) == len(want) and set(got.itertuples(index=False, name=None)) == set(want.itertuples(index=False, name=None))
