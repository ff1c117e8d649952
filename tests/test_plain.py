"""Registered queries without SQL against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np

from skein import catalogue
from skein.operators import topics

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_chunk_titles(spark):
    want = set()
    for r in rows(spark, "documents"):
        if r.text is None:
            continue
        head = len(r.text) - len(re.sub(r"^[ \t\n\x0b\f\r]+", "", r.text))
        body = re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", r.text)
        at, k = 0, 0
        while body:
            want.add((r.doc_id, k, body.split("\n")[0][:80], r.text[: head + at].count("\n") + 1))
            if at + 1200 >= len(body):
                break
            at, k = at + 1050, k + 1
    got = catalogue.QUERIES["chunk_titles"](spark, SF).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_topic_records(spark):
    """Sizes, terms by tf * ln(N / df), and the titles nearest the middle of each cluster, from the clusters that the map gives."""
    e = {r.vec_id: (r.label % 3, np.array(r.embedding, float)) for r in rows(spark, "embeddings")}
    docs = [(r.doc_id, *e[r.doc_id % len(e)], r.text or "", " ".join(x for x in (r.lang, r.source) if x is not None)) for r in rows(spark, "documents")]
    df = spark.createDataFrame([(c, i, [float(x) for x in v]) for i, c, v, *_ in docs], "corpus int, id long, embedding array<double>")
    cluster = {(r.corpus, r.id): r.cluster for r in topics.clustered(df).collect()}
    stop = set(topics.STOPWORDS)
    counts = {i: Counter(w for w in re.findall(topics.TERM, f"{t} {title}".lower()) if w not in stop) for i, _, _, t, title in docs}
    got = {(r.corpus, r.cluster): r for r in catalogue.QUERIES["topic_records"](spark, SF).collect()}
    groups = defaultdict(list)
    for d in docs:
        groups[d[1], cluster[d[1], d[0]]].append(d)
    assert got.keys() == groups.keys()
    n, df_ = Counter(d[1] for d in docs), defaultdict(Counter)
    for i, c, *_ in docs:
        df_[c].update(counts[i].keys())
    for (c, k), own in groups.items():
        r = got[c, k]
        tf = sum((counts[d[0]] for d in own), Counter())
        score = {t: round(m * math.log(n[c] / df_[c][t]), 9) for t, m in tf.items() if df_[c][t] < n[c]}
        best = sorted(score, key=lambda t: (-score[t], t))[:6]
        assert (r["size"], r.terms, r.label, r.last_active) == (len(own), best, ", ".join(best[:3]), "2024")
        mean = np.mean([d[2] for d in own], axis=0)
        near = defaultdict(lambda: -np.inf)
        for d in own:
            near[d[4]] = max(near[d[4]], float(d[2] @ mean))
        assert {round(near[t], 9) for t in r.exemplars} == {round(x, 9) for x in sorted(near.values(), reverse=True)[: len(r.exemplars)]}


def test_choice_by_relevance_and_novelty(spark):
    got = catalogue.QUERIES["mmr_diversify"](spark, SF).collect()
    e = rows(spark, "embeddings")
    v = {r.vec_id: np.array(r.embedding, float) for r in e}
    q = v[0]
    for corpus in {f"c{r.label % 4}" for r in e}:
        pool = sorted((r.vec_id for r in e if f"c{r.label % 4}" == corpus), key=lambda i: (-(v[i] @ q), i))[:50]
        chosen = []
        while len(chosen) < min(10, len(pool)):
            value = {i: (v[i] @ q) if not chosen else 0.7 * (v[i] @ q) - 0.3 * max(v[i] @ v[j] for j in chosen) for i in pool if i not in chosen}
            chosen.append(max(value, key=lambda i: value[i]))
        assert [r.id for r in sorted((r for r in got if r.corpus == corpus), key=lambda r: r.place)] == chosen


def test_hashes_of_files(spark, tmp_path):
    import hashlib

    from skein.sources import versions

    data = {"a.bin": b"\x00\xff", "d/e.txt": "ü".encode(), "d/void": b""}
    for name, body in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    del data["d/void"]  # an empty file
    got = {r.relpath: (r.sha256, r.bytes) for r in versions.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {k: (hashlib.sha256(v).hexdigest(), len(v)) for k, v in data.items()}


def test_versions_of_topics(spark):
    from skein.sources import versions

    meta = {"build": "7", "model": "m"}
    assert not versions.topics_stale(meta, meta) and versions.topics_stale(None, meta) and versions.topics_stale({"build": "6"}, meta) and versions.topics_stale({}, meta)
