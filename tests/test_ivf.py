"""The store of lists, the check of a published index, and its import against a walk over the bytes."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.text import unpaged
from skein.sources import ivf, vector_index


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    x = centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 8))
    x[:1500] = centres[3] + 0.2 * rng.normal(size=(1500, 8))  # one list holds over a third of all
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, embedding array<double>")
    centroids = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(c)], "cluster_id int, embedding array<double>")
    path = str(tmp_path_factory.mktemp("ivf"))
    ivf.store(ivf.assigned(rows, centroids), centroids, path, file_rows=200)
    return x, c, rows, centroids, path


def test_every_row_is_in_its_nearest_list(spark, stored, monkeypatch):
    x, c, rows, centroids, path = stored
    own = (x @ c.T).argmax(axis=1)
    assert {r.id: r.cluster_id for r in spark.read.parquet(f"{path}/vectors").select("id", "cluster_id").collect()} == dict(enumerate(own.tolist()))
    monkeypatch.setattr(ivf, "BLOCK_NUMBERS", 60)  # seven centroids at a time
    got = ivf.nearest_lists(rows.limit(300).unionByName(spark.createDataFrame([(-1, None)], "id long, embedding array<double>")), centroids, 5)
    for r in got.collect():
        assert [y.cluster_id for y in r.lists] == ([] if r.id < 0 else np.argsort(-(x[r.id] @ c.T), kind="stable")[:5].tolist())


def test_only_the_probed_lists_are_read(spark, stored):
    x, c, _, _, path = stored
    queries = spark.createDataFrame([(q, [float(a) for a in x[q]]) for q in (2000, 3000)], "query_id long, _q array<double>")
    hits = ivf.probed(spark, path, queries, probes=3, k=10)
    got = {q: [r.id for r in hits.filter(F.col("query_id") == q).orderBy("rank").collect()] for q in (2000, 3000)}
    own = (x @ c.T).argmax(axis=1)
    for q, ids in got.items():
        lists = np.argsort(-(x[q] @ c.T), kind="stable")[:3]
        among = np.flatnonzero(np.isin(own, lists))
        assert ids == among[np.lexsort((among, -(x[among] @ x[q])))][:10].tolist() and ids[0] == q
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    hits.collect()
    seen = []

    def walk(node):
        metrics = node.metrics()
        if metrics.contains("numPartitions"):
            seen.append(metrics.apply("numPartitions").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            walk(node.plan())

    walk(hits._jdf.queryExecution().executedPlan())
    assert max(seen) <= 6 < 40


def test_facade_reads_the_probed_lists(spark, stored):
    """The engine's own search over the stored table prunes its folders too, unless a filter asks for all."""
    from skein.engine import Engine

    x, c, _, centroids, path = stored
    rows = spark.read.parquet(f"{path}/vectors").select(F.lit("c").alias("corpus"), F.concat(F.lit("f"), "id").alias("file"), F.lit(0).alias("chunk_idx"), F.lit(0).alias("sub_idx"), F.lit("t").alias("title"), F.lit("text").alias("text"), F.lit("2024").alias("chunk_date"), "cluster_id", "embedding")
    engine = Engine(spark, {"chunks": rows, "centroids": centroids.withColumn("corpus", F.lit("c"))}, lambda text: [float(a) for a in x[int(text)]], {"nprobe": "2"})
    got = engine.search_corpus("c", "77", limit=5, diversify=False)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString() and got.collect()[0].file == "f77"
    assert "dynamicpruning" not in engine.search_corpus("c", "77", limit=5, since="2023")._jdf.queryExecution().executedPlan().toString()


def test_blocks_give_what_all_pairs_give(spark, tmp_path, monkeypatch):
    """Small blocks, equal rows, vectors that are null, short or hold no number: as ranked over all pairs."""
    from skein.functions.vectors import dot

    for name, size in (("BLOCK_ROWS", 40), ("BLOCK_QUERIES", 7), ("TILE", 16), ("TILE_QUERIES", 3)):
        monkeypatch.setattr(ivf, name, size)
    rng = np.random.default_rng(3)
    data = [(i % 2, i, [float(a) for a in rng.integers(-2, 3, 4)]) for i in range(400)]
    data[5:12] = [(1, 5, None), (0, 6, [1.0, None, 1.0, 1.0]), (1, 7, [1.0]), (0, 8, [float("nan")] * 4), (1, 9, [float("inf"), 0.5, 0.5, 0.5]), (0, 10, []), (1, None, [9.0] * 4)]
    rows = spark.createDataFrame(data, "cluster_id int, id long, embedding array<double>")
    centroids = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0])], "cluster_id int, embedding array<double>")
    ivf.store(rows, centroids, str(tmp_path))
    queries = spark.createDataFrame([(q, data[q][2]) for q in range(20, 60)], "query_id long, _q array<double>")
    for k in (10, 1000):
        got = ivf.probed(spark, str(tmp_path), queries, probes=2, k=k, columns=["id"])
        assert "FlatMapCoGroups" in got._jdf.queryExecution().executedPlan().toString()
        pairs = queries.crossJoin(rows).select("query_id", "id", dot(F.col("embedding"), F.col("_q")).alias("score"))
        pairs.createOrReplaceTempView("pairs")
        want = spark.sql(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs) WHERE rank <= {k}")
        assert sorted(map(repr, got.select("query_id", "id", "score", "rank").collect())) == sorted(map(repr, want.select("query_id", "id", "score", "rank").collect()))


TEXT = (
    b"Title of it\n\n1. Intro\n\n   Some words that run\n   over lines, a sentence broken\n\nDoe & Roe       Standards Track        [Page 1]\n\x0c\nRFC 99          On Things          May 1999\n\n"
    b"   by a page. And more.\n   |  figure |\n     +------+\n2. Next\n   last words \xff here\n"
)


def published(tmp_path, rows_, dims=4, per=2, **other):
    """An index of chunks (doc, off, len, section, title), so many a cluster."""
    rng, n = np.random.default_rng(1), -(-len(rows_) // per)
    (tmp_path / "clusters").mkdir(parents=True)
    for k in range(n):
        own = rows_[k * per : (k + 1) * per]
        texts = sorted({c[3] for c in own if c[3]} | {c[4] for c in own})
        tail = {"n": len(own), "str": texts, "rfc": [c[0] for c in own], "off": [c[1] for c in own], "len": [c[2] for c in own], "sec": [texts.index(c[3]) if c[3] else -1 for c in own], "title": [texts.index(c[4]) for c in own]}
        (tmp_path / f"clusters/{k:04d}.bin").write_bytes(vector_index.encoded(rng.integers(-9, 9, (len(own), dims)), k, tail))
    (tmp_path / "centroids.bin").write_bytes(vector_index.encoded(rng.integers(-9, 9, (n, dims)), magic=vector_index.CENTROIDS))
    info = {"version": 1, "build": "b", "source": {"commit": "x"}, "model": {"id": "m", "dims": dims}, "quant": {"scale": 0.01}, "chunks": {"count": len(rows_)}, "clusters": {"count": n, "nprobe": 3}}
    (tmp_path / "manifest.json").write_text(json.dumps(info | other))
    return str(tmp_path)


CHUNKS = [("99", 0, 12, None, "head"), ("99", 13, 60, "1", "Intro"), ("99", 60, 172, "1", "Intro"), ("99", 13, 20, "1", "Intro"), ("99", TEXT.index(b"2. Next"), 30, "2", "Next"), ("17a", 0, 5, "1", "Other")]


def test_whole_index_check_names_what_is_wrong(spark, tmp_path):
    path = published(tmp_path / "good", CHUNKS)
    faults, sums = vector_index.checked(spark, path)
    assert faults.count() == 0 and sums == {"chunks": 6, "clusters": 3, "empty": 0, "sectioned": 5, "documents": 2, "centroids": 3}
    assert vector_index.manifest(spark, path)["clusters.nprobe"] == "3"
    bad = tmp_path / "bad"
    published(bad, CHUNKS, chunks={"count": 7})
    (bad / "clusters/0000.bin").write_bytes((bad / "clusters/0000.bin").read_bytes()[:-3])
    (bad / "clusters/0001.bin").rename(bad / "clusters/0007.bin")
    (bad / "centroids.bin").write_bytes(vector_index.encoded(np.zeros((2, 4)), magic=vector_index.CENTROIDS))
    got = {(r.file, r.fault) for r in vector_index.checked(spark, str(bad))[0].collect()}
    assert {("0000.bin", "size and header differ"), ("0000.bin", "missing"), ("0007.bin", "declares cluster 1"), ("centroids.bin", "2 centroids for 3 clusters")} <= got
    assert {f for f, _ in got} == {"0000.bin", "0007.bin", "centroids.bin", "manifest.json"}
    with pytest.raises(vector_index.FormatError, match="source.commit"):
        vector_index.manifest(spark, published(tmp_path / "old", CHUNKS, source={}))


def test_import_joins_ranges_to_texts(spark, tmp_path):
    path = published(tmp_path, CHUNKS)
    texts = spark.createDataFrame([("99", bytearray(TEXT)), ("17a", bytearray(b"other text"))], "doc string, content binary")
    (tmp_path / "sources.json").write_text(json.dumps({"digest": "sha256", "rfcs": {"99": hashlib.sha256(TEXT).hexdigest(), "17a": "0" * 64}}))
    rows, gone = vector_index.imported(vector_index.read_clusters(spark, f"{path}/clusters"), texts, vector_index.sources(spark, path))
    assert [(r.doc, r.why) for r in gone.collect()] == [("17a", "changed")]
    got = rows.orderBy("chunk_idx").collect()
    assert [r.chunk_idx for r in got] == list(range(len(got))) and [r.section for r in got] == [None, "1", "1", "1", "2"]
    # a section's ranges don't overlap and lose no line; the page is gone and its sentence whole
    whole = "\n".join(r.text for r in got if r.section == "1")
    assert whole.count("Some words") == 1 and "Page 1" not in whole and "RFC 99" not in whole and "|  figure |" in whole and "+------+" in whole
    assert got[-1].text == "2. Next\n   last words � here"
    assert vector_index.imported(vector_index.read_clusters(spark, f"{path}/clusters"), texts.limit(0))[1].count() == 2


def test_tiling_equals_a_walk():
    rng = np.random.default_rng(8)
    for _ in range(60):
        raw = bytes(rng.choice([10, 65, 66], 80, p=[0.15, 0.4, 0.45]).tolist())
        n = 9
        off, length, section = rng.integers(0, 70, n), rng.integers(0, 30, n), rng.integers(0, 3, n)
        start, end = vector_index.tiled(off, length, section, raw)
        for s in range(3):
            covered = 0
            for i in sorted(np.flatnonzero(section == s), key=lambda i: (off[i], length[i])):
                first = covered if covered > off[i] else raw.rfind(b"\n", 0, off[i]) + 1
                feed = raw.find(b"\n", off[i] + length[i])
                last = len(raw) if feed < 0 else feed + 1
                assert (start[i], end[i]) == (first, last)
                covered = max(covered, last)


def test_pages(spark):
    cases = {
        "   a line that\n\n\nX  [Page ii]\n\x0c\nRFC 1   T   June 2001\n\n   goes on": "a line that\n\n\ngoes on",
        "   a line that\nX  [Page ii]\n\x0cRFC 1   T   June 2001\n   goes on": "a line that goes on",
        "   It ends.\nX  [Page 3]\n\x0c\n   small begins": "It ends.\nsmall begins", "  a\n\n    b  \n  c": "a\n\n  b\nc", "": "", "\x0cBody": "Body", "no indent\n  x": "no indent\n  x",
        "in May 2001\nand on": "in May 2001\nand on",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", unpaged(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases
