"""Each operator against a plain version, on a table of awkward rows: nulls, empty and very long texts, ties, repeats, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import ann, chat, licenses, lm, minhash, mixing, packing, pieces, quality, rabitq
from skein.llm.queries import tokenizer_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(400)]


def words(text):
    return WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


@pytest.fixture(scope="module")
def awkward():
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join(rng.choice(VOCABULARY, n))
    base, long = prose(120), prose(30_000)
    near = base.split()
    near[7] = "other"
    rows = [
        (1, base, "a"), (2, " ".join(near), "a"), (3, base.upper(), "b"), (4, None, "a"), (5, "", "b"), (6, " \t\n", None), (7, "one", "a"), (8, "One", "b"), (9, "one two", None),
        (10, long, "a"), (11, long + " more", "a"), (12, "naïve ÉTÉ 日本語 🙂 don't [INST] </s>", "b"), (12, "repeated id " + prose(40), "b"), (13, "x" * 50_000, "a"), (13, "x" * 50_000, "a"),
        (None, "no id " + prose(30), "a"), (None, None, None), (-4, "mit license apache license", "a"), *((100 + i, prose(int(rng.integers(1, 60))), "abc"[i % 3]) for i in range(40)),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark, awkward):
    clash = "rid", "cls", "task", "h", "size", "start", "shard", "_n", "_id", "held_out", "spans", "n", "key", "_group"
    df = spark.createDataFrame(awkward, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("clash").alias(c) for c in clash))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def table(df, *keys):
    return df.toPandas().sort_values(list(keys), kind="stable").reset_index(drop=True)


def groups(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("size", [2, 5])
def test_minhash(docs, none, awkward, size):
    sets = []
    for _, text, _ in awkward:
        w = words(text)
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    own = groups(len(sets), pairs)
    least = {}
    for i, g in enumerate(own):
        if awkward[i][0] is not None:
            least[g] = min(least.get(g, awkward[i][0]), awkward[i][0])
    want = Counter((awkward[i][0], len(sets[i]), least.get(g)) for i, g in enumerate(own))
    got = minhash.near_duplicates(docs, size=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(none, size=size).count() == 0


def test_minhash_finds_every_planted_copy(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for g in range(150):
        base = list(rng.choice(VOCABULARY, 150))
        for _ in range(3):
            own = list(base)
            own[int(rng.integers(150))] = "edit"
            rows.append((k, " ".join(own), g))
            k += 1
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, g long"), size=5).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 3 for i in range(k)}


def test_minhash_large_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK_TEXTS", 40)
    rng = np.random.default_rng(3)
    base = list(rng.choice(VOCABULARY, 200))
    rows = []
    for i in range(170):
        own = list(base)
        own[i] = f"edit{i}"
        rows.append((i, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.component_id for r in got} == {0}


def test_minhash_against_brute_force_in_small_chunks(spark, monkeypatch):
    """Copies at all similarities around the bar, in groups cut into chunks, with boilerplate that all share."""
    for name, value in (("CHUNK_TEXTS", 15), ("CHUNK_SIGNATURES", 12), ("TASK_SIGNATURES", 30), ("BROADCAST_ROWS", 5)):
        monkeypatch.setattr(minhash, name, value)
    rng = np.random.default_rng(8)
    boiler = list(rng.choice(VOCABULARY, 40))
    rows, k = [], 0
    for g in range(6):
        base = list(rng.choice(VOCABULARY, 60))
        for _ in range(25):
            own = boiler + base
            for at in rng.choice(60, int(rng.integers(0, 9)), replace=False):
                own[40 + int(at)] = f"edit{rng.integers(1000)}"
            rows.append((k, " ".join(own)))
            k += 1
    rows += [(None, rows[3][1]), (None, rows[3][1]), (5, "another text of the same id")]
    sets = [{tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)} for _, t in rows]
    own = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    want = Counter((rows[i][0], rows[g][0]) for i, g in enumerate(own))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == want


def test_distinct_rows_lose_no_unique_document(spark, docs, awkward):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    a, b, c, d, e = (" ".join(rng.choice(VOCABULARY, 60)) for _ in range(5))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (None, d), (5, d), (7, e), (7, e), (8, ""), (8, ""), (None, None), (None, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter([(1, a), (2, b), (None, c), (5, d), (7, e), (8, ""), (8, ""), (None, None), (None, " ")])
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == want
    out = minhash.distinct_rows(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, *_ in awkward if i not in (2, 3, 8, 11)) - Counter([13])
    assert minhash.distinct_rows(df.limit(0)).count() == 0


def test_bayes_bars_keep_true_pairs():
    bars = minhash.least_matches(0.8)
    for n, bar in zip(range(minhash.BATCH, minhash.BANDS * minhash.ROWS + 1, minhash.BATCH), bars, strict=True):
        below = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(bar))
        assert below < 1e-4


def test_mixing(docs, none, awkward):
    from pyspark.sql import functions as F

    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.lit(1).alias("sid"), F.lit(1).alias("block"))
    got = mixing.mix(sizes, block_words=64).toPandas()
    again = mixing.mix(sizes, block_words=64).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
    assert sorted(got["size"]) == sorted(len(words(t)) for _, t, _ in awkward)
    assert (got.taken <= 2 * got["size"]).all()
    per = {}
    for _, text, source in awkward:
        per[source] = per.get(source, 0) + len(words(text))
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight, total, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(per.values()), {}
    free = set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * per[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * per[s] for s in over}
        free -= over
    for s in order:
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert own.target.iloc[0] == pytest.approx(target[s])
        assert own.taken.sum() == round(target[s])
    assert mixing.mix(sizes.limit(0)).count() == 0


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs.select("doc_id", "text", "source", "_n", "n"), block_words=64)
    assert out.columns == ["doc_id", "text", "source", "_n", "n"] or "n_chars" not in out.columns
    from pyspark.sql import functions as F

    got = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    want = {r[0]: r[1] for r in mixing.mix(sizes, block_words=64).groupBy("source").agg(F.sum("taken")).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_mix_follows_the_schedule(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{i}.{k}" for k in range(int(rng.integers(1, 90)))), "abc"[min(2, i % 5)]) for i in range(300)] + [(7, "again again", "b"), (7, "again again", "b"), (None, "no id", "a"), (9, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = [r.asDict() for r in mixing.blocks(sizes, block_words=64).collect()]
    slots, first, taken = {}, {}, Counter()
    for r in got:
        slots.setdefault(r["slot"], []).append(r)
        taken[r["doc_id"], r["source"], r["size"]] += r["words"]
        if r["first"] == 0:
            first[r["source"], r["start"], r["pass"]] = (r["slot"], r["place"], r["doc_id"])
    assert [(r["slot"], r["place"]) for r in got] == sorted((r["slot"], r["place"]) for r in got)
    short = Counter()
    for own in slots.values():
        assert len({(r["source"], r["pass"], r["block"]) for r in own}) == 1
        assert [r["place"] for r in own] == [sum(x["words"] for x in own[:k]) for k in range(len(own))]
        assert all(r["start"] + r["first"] == r["block"] * 64 + r["place"] for r in own)
        short[own[0]["source"]] += sum(r["words"] for r in own) < 64
    assert all(n <= 3 for n in short.values())
    mixed = Counter()
    for r in mixing.mix(sizes, block_words=64).collect():
        mixed[r.doc_id, r.source, r.size] += r.taken
    assert +mixed == taken
    # Every prefix of the schedule has each source's share of the slots within the discrepancy of the points.
    dealt = [own[0]["source"] for _, own in sorted(slots.items())]
    total = Counter(dealt)
    for k in range(1, len(dealt) + 1):
        have = Counter(dealt[:k])
        assert all(abs(have[s] - k * total[s] / len(dealt)) <= 2 * math.log2(len(dealt)) for s in total)
    out = mixing.mixed_documents(docs, block_words=64).collect()
    assert [r.doc_id for r in out] == [d for _, _, d in sorted(first.values(), key=lambda x: x[:2])]


def test_packing(docs, none, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    got = packing.packed_documents(docs, tokenizer_path()).toPandas()
    want = Counter()
    total = 0
    for doc_id, text, _ in awkward:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        for p, low in enumerate(range(0, len(ids), 4096)):
            part = ids[low : low + 4096]
            want[(doc_id, p, low, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)
    assert Counter((None if d != d else int(d), *map(int, x)) for d, *x in rows) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() <= 4096
    assert got.sequence_id.nunique() <= math.ceil(total / 4096) + 1
    assert packing.packed_documents(none, tokenizer_path()).count() == 0


def test_packing_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 64)
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 3000, 400)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(sizes)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")).toPandas()
    assert sorted(got.doc_id) == list(range(400))
    load = got.groupby("sequence_id").length.sum()
    assert load.max() <= 4096 and len(load) <= 1.05 * math.ceil(sizes.sum() / 4096)


def test_packing_saves_bins_against_best_fit(spark):
    """Sizes of a quarter to a half of the capacity, where best fit by falling size leaves gaps; also as sum of all gaps."""
    rng = np.random.default_rng(16)
    sizes = rng.integers(1025, 2049, 2000)
    plain = packing.best_fit(np.full(2000, -1), sizes, np.argsort(-sizes, kind="stable"), 4096)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(sizes)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")).toPandas()
    assert sorted(got.doc_id) == list(range(2000)) and got.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() < plain.max() + 1


def test_chunks_of_words_have_the_library_ids():
    from tokenizers import Tokenizer

    from skein.llm.tokens import WordEncoder

    library, words_ = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path())
    texts = ["Don't STOP naïve ÉTÉ 日本語", "", "a  b\n\tc", "x" * 3000, "🙂 it's 12345", "again again"]
    for some in (texts, [*texts, "<|endoftext|> <|EndOfText|>"]):
        body = [t.encode() for t in some]
        at = np.concatenate([[0], np.cumsum([len(b) for b in body])])
        ids, first = words_.chunk(np.frombuffer(b"".join(body), np.uint8), at)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 3000, 300)
    a, b = (packing.renumbered(packing.best_fit(np.full(300, -1), sizes, rng.permutation(300), 4096)) for _ in range(2))
    for _ in range(20):
        a = packing.crossover(a, b, sizes, 4096, rng)
        assert (a >= 0).all() and np.bincount(a, sizes).max() <= 4096 and len(np.unique(a)) == a.max() + 1


def test_token_counts(docs, none, awkward):
    vocabulary = pieces.vocabulary(tokenizer_path())
    longest = max(map(len, vocabulary))

    def greedy(w):
        n = i = 0
        while i < len(w):
            i = next(j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in vocabulary)
            n += 1
        return n

    want = Counter((d, len(words(t)), sum(map(greedy, words(t)))) for d, t, _ in awkward)
    got = pieces.token_counts(docs, tokenizer_path())
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_tokens").collect()) == want
    assert pieces.token_counts(none, tokenizer_path()).count() == 0


def test_longest_match_pops():
    machine = pieces.Automaton({b"a", b"b", b"c", b"ab", b"abcd", b"bc", b"d"})
    text = np.frombuffer(b"abcdabcabca", np.uint8)
    # abcd | ab c | ab c a
    assert machine.lengths(text, np.array([0, 4, 7, 0]), np.array([4, 7, 11, 11])).tolist() == [1, 2, 3, 6]


def test_licenses(docs, none, awkward):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for doc_id, text, _ in awkward:
        w = pattern.findall((text or "").encode().lower())
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.encode().split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        want[(doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))] += 1
    got = licenses.scanned(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == want
    assert licenses.scanned(none).count() == 0


def test_license_passages(spark):
    text = licenses.PASSAGES["mit-text"].replace("restriction", "any restriction").replace("merge ", "")
    rows = [(1, "before it " + text.upper() + " after it"), (2, " ".join(reversed(text.split()))), (3, "cc by cc by"), (3, "cc by cc by")]
    got = {(r.doc_id): r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit-text" and 0.9 < got[1].score < 1 and got[1].base_labels == ""
    assert got[2].labels == "" and got[2].score == 0
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 2)


def test_lm(docs, none, awkward):
    tokens = [[*words(t), None] for _, t, _ in awkward]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _, _ in awkward]
    c = Counter(w for x, h in zip(tokens, held, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    got = lm.scored(docs).collect()
    base = lambda x: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
    want = Counter((awkward[i][0], held[i], len(x), sum(c[w] > 0 for w in x), n, round(base(x), 4)) for i, x in enumerate(tokens))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.scored(none).count() == 0


def test_lm_rare_words_are_joined_alike(docs):
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4))
    whole = sorted(map(key, lm.scored(docs).collect()))
    few = sorted(map(key, lm.scored(docs, head_words=300).collect()))
    assert [x[:4] for x in few] == [x[:4] for x in whole]


def test_lm_scores_like_a_plain_softmax(spark, docs, awkward):
    """`score` from the fitted vectors by a sum over all buckets for each token, without the engine's tables."""
    small = lm.Fit(buckets=64, size=8, noise=16, batch=128)
    marked = lm.marked(docs)
    learn = marked.filter("not held_out")
    counts = lm.word_counts(learn)
    head = lm.head_of(counts, 100)
    buckets = lm.bucketed(head, counts, small.buckets)
    assert buckets.shared == 32 and len(buckets.keys) == 30
    model = lm.trained(learn, head.tokens, buckets, small)
    c = Counter(w for (d, t, _) in awkward if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1 for w in [*words(t), None])
    h = lambda w: lm.END if w is None else lm.tokens(lm.split(np.frombuffer(w, np.uint8), np.array([0, len(w)])))[0][0]
    place = {w: int(buckets.of(np.array([h(w)]))[0]) for w in {x for _, t, _ in awkward for x in [*words(t), None]}}
    mass = Counter()
    for w in c:
        mass[place[w]] += c[w] + 0.5
    want = []
    for doc_id, text, _ in awkward:
        total, v = 0.0, lm.LAST
        for w in [*words(text), None]:
            k = place[w] if w in c else lm.UNSEEN
            s = model.q.astype("f8") @ model.r[v].astype("f8") + model.b
            total += s[k] - np.log(np.exp(s).sum())
            total += math.log((c[w] + 0.5) / mass[k]) if k >= lm.OWN else 0
            v = place[w]
        want.append((str(doc_id), round(total / math.log(10), 1)))
    got = [(str(r.doc_id), round(r.score, 1)) for r in lm.scored(docs, small, head_words=100).collect()]
    assert all(a == x and abs(b - y) <= 0.11 + 1e-3 * abs(b) for (a, b), (x, y) in zip(sorted(want), sorted(got), strict=True))


def test_lm_learns_what_follows_what(spark):
    rng = np.random.default_rng(6)
    # after "a" comes "b", after "b" "c" or "d"
    rows = [(i, " ".join(x for _ in range(40) for x in ("a", "b", rng.choice(["c", "d"])))) for i in range(400)]
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > 0.3 * held.base_score.sum()


def test_lm_beats_a_discounted_bigram_on_held_out_texts(spark):
    """Absolute discounting of word pairs over the smoothed unigram, on the smallest table of documents."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = lm.scored(rows).toPandas()
    texts = [(zlib.crc32(str(r.doc_id).encode()) % 5 == 1, [None, *words(r.text), None]) for r in rows.collect()]
    learn = [x for held, x in texts if not held]
    c, pairs = Counter(w for x in learn for w in x[1:]), Counter(p for x in learn for p in zip(x, x[1:], strict=False))
    n, v, after, kinds = sum(c.values()), len(c), Counter(), Counter()
    for (a, _), k in pairs.items():
        after[a] += k
        kinds[a] += 1
    total = 0.0
    for held, x in texts:
        for a, b in zip(x, x[1:], strict=False) if held else ():
            one = (c[b] + 0.5) / (n + 0.5 * (v + 1))
            total += math.log10((max(pairs[a, b] - 0.75, 0) + 0.75 * kinds[a] * one) / after[a] if after[a] else one)
    assert got[got.held_out].score.sum() > total > got[got.held_out].base_score.sum()


def test_lm_averages_rows_by_use():
    fit = lm.Fit(size=4)
    a, b = (lm.Model.started(np.ones(5), fit) for _ in range(2))
    a.weights[0, 2], b.weights[0, 2], b.weights[0, 3] = 1, 3, 2
    a.r[2], b.r[2], b.r[3] = 0, 4, 9
    both = lm.Model.unpacked(a.joined(b).packed(), 5, 4)
    assert (both.r[2] == 3).all() and (both.r[3] == 9).all() and np.allclose(both.r[1], a.r[1], atol=1e-3) and both.weights[0].tolist() == [0, 0, 4, 2, 0]


def test_quality(spark, none):
    rng = np.random.default_rng(7)
    prose = lambda n: " ".join(rng.choice(VOCABULARY, n))
    rows, labels = [], []
    for i in range(4500):
        kind = i % 3
        text = prose(60) + (" insult" if kind == 0 else "") + (" !!! $$$" * 6 if kind == 1 else "")
        rows.append((i, text))
        if i < 4200:
            labels.append((i, int(kind != 1), int(kind == 0)))
    rows += [(10_000, None), (10_001, ""), (None, "insult"), (10_002, "w1 " * 60_000), (10_002, "w1 " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.graded(labels), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    got = quality.classified(docs, model).toPandas()
    test = got[(got.doc_id >= 4200) & (got.doc_id < 4500)]
    assert (test.keep == (test.doc_id % 3 == 2)).mean() > 0.97
    assert len(got) == len(rows) and got.expected_grade.between(0, 2).all() and got.p_top.between(0, 1).all()
    order = [test[test.doc_id % 3 == k].expected_grade.mean() for k in (0, 1, 2)]
    assert order == sorted(order)
    kept = quality.selected(docs, model)
    assert kept.columns == docs.columns
    empty = quality.train(none, quality.graded(labels.limit(0)), 3)
    assert quality.classified(none, empty).count() == 0 and quality.classified(docs, empty).count() == len(rows)


def test_quality_sample_ends_where_its_features_do(spark):
    """As a fit on the texts of the least hashes alone; columns of any name are kept beside."""
    rng = np.random.default_rng(31)
    rows = [(i, " ".join(rng.choice(VOCABULARY, 30)), int(i % 3)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    whole = quality.train(docs, ratings, 3)
    few = quality.train(docs, ratings, 3, most=600)
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    sizes = [len(np.unique(next(quality.features(pa.array([dict((i, t) for i, t, _ in rows)[d]])))[1])) for d in order]
    n = int(np.searchsorted(np.cumsum(sizes), 600, "right"))
    assert 5 < n < 40
    same = quality.train(docs, ratings, 3, sample=n)
    assert (few.keys == same.keys).all() and np.allclose(few.weights, same.weights) and len(few.keys) < len(whole.keys)
    odd = docs.withColumn("__rated", F.lit(1)).withColumn("_", F.lit(2))
    assert quality.selected(odd, whole).columns == odd.columns


def test_quality_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(14)
    score, y, bars = rng.normal(size=50), rng.integers(0, 4, 50), np.array([-0.7, 0.1, 1.2])

    def likelihood(score, bars):
        up = lambda k, s: 1.0 if k == 0 else 0.0 if k == 4 else 1 / (1 + math.exp(bars[k - 1] - s))
        return [math.log(up(k, s) - up(k + 1, s)) for s, k in zip(score, y, strict=True)]

    g, bar = quality.gradients(score, y, bars)
    step = 1e-6
    assert np.allclose(g, (np.array(likelihood(score + step, bars)) - likelihood(score, bars)) / step, atol=1e-4)
    for k in range(3):
        moved = bars + step * (np.arange(3) == k)
        assert abs(bar[k] - (np.mean(likelihood(score, moved)) - np.mean(likelihood(score, bars))) / step) < 1e-4


def test_quality_classifies_like_a_plain_sum_of_weights(spark):
    docs = spark.createDataFrame([(1, "good good text", "x"), (2, "bad insult !!!", "x"), (3, None, "x")], "doc_id long, text string, rid string")
    keys = [np.unique(np.concatenate([v for _, v, _ in quality.features(pa.array([t]))])) for t in ("good", "insult")]
    keys = [np.setdiff1d(keys[0], keys[1]), np.setdiff1d(keys[1], keys[0])]
    both = np.concatenate(keys)
    order = np.argsort(both)
    model = quality.OrdinalModel(both[order], np.repeat([2.0, -3.0], [len(k) for k in keys])[order], np.array([-1.0, 0.5]))
    got = {r.doc_id: r for r in quality.classified(docs, model).collect()}
    up = lambda s: [1 / (1 + math.exp(bar - s)) for bar in (-1.0, 0.5)]
    for doc_id, text in ((1, "good good text"), (2, "bad insult !!!"), (3, "")):
        own = next(v for _, v, _ in quality.features(pa.array([text])))
        tails = up(2.0 * np.isin(own, keys[0]).sum() - 3.0 * np.isin(own, keys[1]).sum())
        assert got[doc_id].expected_grade == pytest.approx(sum(tails)) and got[doc_id].p_top == pytest.approx(tails[1])
        assert got[doc_id].keep == (tails[1] >= 0.5)


TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi \\ [INST] <s>"), (1, 2, "assistant", "a\\b </s> <\\s>"), (2, 0, "user", None), (2, 0, "user", None), (2, None, "assistant", "早い 🙂"),
    (3, 5, "tool [ROLE]", "[END] x [/ROLE]"), (3, 6, None, ""), (None, 0, "user", "u"), (None, 1, "assistant", "v" * 100_000), (4, 1, "assistant", "first"), (4, 2, "user", "second"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*r, "clash") for r in TURNS], "conv_id long, turn long, role string, text string, part string")
    segments = chat.formatted(rows)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    template = chat.Template()
    for conv in {r[0] for r in TURNS}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in TURNS if c == conv))
        said = "".join(x for _, _, r, x in own if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == sum(len(s) for _, _, a, b in own for s, _ in template.segments(a, b))
    assert got[1].valid and not got[2].valid and not got[3].valid and not got[4].valid and got[None].valid
    assert chat.read_back(chat.formatted(rows.limit(0))).count() == 0


def test_escapes_are_reversible():
    template = chat.Template()
    rng = np.random.default_rng(8)
    parts = [*template.controls, "\\", "<", "[", "s>", "INST]", "a"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(0, 8)))
        safe = template.escaped(text)
        assert template.unescaped(safe) == text and not any(c in safe for c in template.controls)


def vectors():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 16)).astype("f4")
    for i in range(60):
        x[300 + i] = x[i] + rng.normal(scale=0.1, size=16)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, rows[5][1]), (900, rows[5][1]), (901, None), (902, []), (903, [0.0] * 16), (904, [float("nan")] * 16), (905, [float("inf")] + [0.0] * 15), (906, [1.0, 2.0]), (None, rows[7][1]), (907, [None] * 16)]
    return rows


def test_near_vectors(spark):
    rows = vectors()
    good = [i for i, (_, v) in enumerate(rows) if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i][1] for i in good], "f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    own = groups(len(good), zip(*np.nonzero(near), strict=True))
    want = Counter()
    for k, i in enumerate(good):
        ids = [rows[good[j]][0] for j in range(len(good)) if own[j] == own[k] and rows[good[j]][0] is not None]
        want[(rows[i][0], int(near[k].sum()) - 1, min(ids))] += 1
    for i, (v, _) in enumerate(rows):
        if i not in set(good):
            want[(v, 0, v)] += 1
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cls int")
    got = rabitq.near_vectors(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert rabitq.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_large_bucket_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(10)
    base = rng.normal(size=16)
    rows = [(i, [float(v) for v in base + rng.normal(scale=0.02, size=16)]) for i in range(230)]
    got = rabitq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(229, 0)}


def test_estimates_are_unbiased_and_within_bounds():
    rng = np.random.default_rng(11)
    for dim in (64, 7):
        x = rabitq.unit(rng.normal(size=(600, dim)))
        coder = rabitq.Coder(dim, 1, 3)
        rows = coder.packed(x, np.zeros((600, 3)))
        assert rows["code"].shape == (600, 16) and rows["copy"].shape == (600, -(-dim // 2))
        rows = coder.unpacked(pa.array([r.tobytes() for r in rows], pa.binary()))
        true, off = x @ x.T, ~np.eye(600, dtype=bool)
        estimate = (coder.signs(rows) @ coder.turned(rows).T) / rows["factor"][:, None]
        wide, slack = coder.margins(rows)
        assert abs((estimate - true)[off].mean()) < 0.005
        assert (np.abs(estimate - true) <= wide[:, None] + slack[:, None] * rows["off"][None])[off].mean() > 0.9999


def test_vectors_of_another_length_take_no_part(spark):
    rng = np.random.default_rng(13)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(300)]
    rows = [*rows, *((i + 1000, v) for i, v in rows[:20]), (5000, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    links = {r.vec_id: r for r in rabitq.near_vectors(df).collect()}
    assert all(links[i].n_links >= 1 and links[i + 1000].component_id == links[i].component_id for i in range(20)) and links[5000].n_links == 0
    found = ann.neighbours(df).toPandas()
    assert set(found.query_id) == {0, 100, 200, *range(1000, 1020, 100)} and 5000 not in set(found.vec_id)


def test_neighbours(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rid int")
    got = ann.neighbours(df, every=20, k=10).toPandas()
    good = [i for i, (_, v) in enumerate(rows) if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i][1] for i in good], "f8")
    hits = total = 0
    for k, i in enumerate(good):
        q = rows[i][0]
        if q is None or q % 20 or q == 900:
            continue
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        d[k] = np.inf
        best = sorted(range(len(good)), key=lambda j: (d[j], rows[good[j]][0] is None, rows[good[j]][0] or 0))[:10]
        own = got[got.query_id == q]
        assert set(own["rank"]) == set(range(1, 11))
        want = {rows[good[j]][0] for j in best}
        hits += len(want & {None if v != v else int(v) for v in own.vec_id})
        total += len(want)
        assert own.sort_values("rank").score.iloc[0] == d[best[0]]
    assert hits >= 0.9 * total
    assert ann.neighbours(df.limit(0)).count() == 0
    few = ann.neighbours(df.filter("vec_id < 4"), every=2, k=10)
    assert few.count() == 2 * 3


def test_the_fit_is_drawn_without_gathering_all(spark, monkeypatch):
    """The sample is bounded in rows and in bytes, repeats itself, and is a filter, not a sort."""
    rng = np.random.default_rng(21)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(4000)], "rid long, embedding array<float>").repartition(6)
    assert len(ann.sampled(rows, 4000, 4)) == 4000
    monkeypatch.setattr(ann, "SAMPLE", 500)
    one, two = ann.sampled(rows, 4000, 4), ann.sampled(rows.repartition(3), 4000, 4)
    assert 400 < len(one) < 600 and (one == two).all()
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 100 * 4 * 8)
    assert 60 < len(ann.sampled(rows, 4000, 4)) < 140


def test_neighbours_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(12)
    hot = [1.0] * 8
    rows = [(i, hot if i % 2 else [float(v) for v in rng.normal(size=8)]) for i in range(600)] + [(1000, hot)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=100, k=10).toPandas()
    own = got[got.query_id == 1000].sort_values("rank")
    assert own.vec_id.tolist() == [2 * i + 1 for i in range(10)] and (own.score == 0).all()


def test_few_lists_are_probed_on_clustered_vectors():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(200, 64))[rng.integers(0, 200, 12_000)] + 0.35 * rng.normal(size=(12_000, 64))
    index = ann.fitted(x, len(x), 10)
    assert ann.probed_share(index, x[::100]) < 0.2
    members = [set() for _ in index.centroids]
    for i, own in enumerate(index.lists(x, ann.SPREAD, ann.WIDTH, ann.REPLICAS)):
        for a in own:
            members[a].add(i)
    hits = 0
    for i, own in zip(range(0, len(x), 100), index.lists(x[::100], index.ratio, index.width, index.width), strict=True):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set().union(*(members[a] for a in own)))
    assert hits >= 0.9 * 10 * 120
