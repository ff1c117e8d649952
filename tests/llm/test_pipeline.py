"""The document pipeline: each stage on awkward rows, and the whole against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import groups, words

import corpus_pipeline
from skein.llm import mixing, quality
from skein.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def awkward(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").filter("text IS NOT NULL AND length(text) BETWEEN 300 AND 900").limit(6).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in good]
    rows += [(None, good[0].text, None, None, None), (None, None, "en", "a", 0), (7_000_001, "", "en", None, 0), (7_000_001, " \n\t", "fr", "b", 3), (7_000_002, "one", None, "b", 3), (7_000_002, good[1].text, "en", "b", 1), (7_000_003, " ".join(good[2].text for _ in range(60)), "en", "c", 9)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns_and_only_drop_rows(spark, awkward, stage):
    out = stage(spark, awkward, SF)
    assert out.columns == awkward.columns
    before = {r.text for r in awkward.collect()}
    for r in out.collect():
        assert r.text in before or any(t and t.startswith(r.text) for t in before)
    assert stage(spark, awkward.limit(0), SF).count() == 0


def test_packing_stage(spark, awkward):
    out = corpus_pipeline.pack_sequences(spark, awkward, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.filter("piece = 0").count() == awkward.count()
    assert corpus_pipeline.pack_sequences(spark, awkward.limit(0), SF).count() == 0


def test_quality_stage_follows_the_model(spark, awkward):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(awkward)
    model = quality.train(docs, quality.graded(labels), 3)
    want = Counter()
    for r in docs.collect():
        own = next(v for _, v, _ in quality.features(pa.array([r.text or ""])))
        at = np.minimum(np.searchsorted(model.keys, own), len(model.keys) - 1)
        score = model.weights[at][model.keys[at] == own].sum()
        if 1 / (1 + math.exp(model.thresholds[-1] - score)) >= 0.5:
            want[r.doc_id, r.text] += 1
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()) == want


def test_near_duplicate_stage_keeps_the_first_of_each_group(spark, awkward):
    rows = awkward.collect()
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    own = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    want = Counter()
    for g in set(own):
        members = [rows[i] for i in range(len(rows)) if own[i] == g]
        ids = sorted(r.doc_id for r in members if r.doc_id is not None)
        want[ids[0] if ids else None] += 1
    assert Counter(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, awkward, SF).collect()) == want


def test_run_agrees_with_plain_versions(spark):
    """Quality by the model's own formula, groups by brute force, texts by the schedule's spans, pieces by the tokenizer library."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    kept = [r for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w := words(r.text)) >= 5 else {tuple(w)} - {()} for r in kept]
    own = groups(len(kept), [(i, j) for i in range(len(kept)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    first = {}
    for i, g in enumerate(own):
        if g not in first or kept[i].doc_id < kept[first[g]].doc_id:
            first[g] = i
    unique = spark.createDataFrame([tuple(kept[i]) for i in first.values()], SCHEMA)
    sizes = unique.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    taken, text = Counter(), {r.doc_id: r.text for r in unique.collect()}
    for r in mixing.blocks(sizes).collect():
        taken[r.doc_id, r["pass"]] += r.words
    library, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for (doc_id, _), n in taken.items():
        ends = [m.end() for m in WORD.finditer(text[doc_id])]
        whole = text[doc_id] if n == len(ends) else text[doc_id][: ends[n - 1]]
        ids = np.array(library.encode(whole, add_special_tokens=False).ids + [1], "<u4")
        for p, low in enumerate(range(0, len(ids), 4096)):
            part = ids[low : low + 4096]
            want[doc_id, p, low, len(part), zlib.crc32(part.tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *np.cumsum(one.length)[:-1].tolist()] and one.length.sum() <= 4096
