"""Sources, versions and streams on temporary files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import streaming
from skein.operators import chunking, people, search, threads
from skein.sources import mail, vector_index, versions

MESSAGE = "From: Jane <jane@example.org>\nSubject: Re: hello\nDate: Mon, 1 Jan 2024 10:00:00 +0200\nMessage-Id: <b@x>\nIn-Reply-To: <a@x>\nReferences: <z@x> <a@x>\nArchived-At: <https://example.org/m/2>\n\nhi\n"


def test_mail(spark, tmp_path):
    (tmp_path / "list").mkdir()
    (tmp_path / "list/1.eml").write_text(MESSAGE)
    (tmp_path / "list/2.eml").write_text("From: x\nDate: nonsense\n\nbody")
    rows = {r.message_id: r for r in mail.read_mail(spark, str(tmp_path)).collect()}
    assert rows["<b@x>"].in_reply_to == "<a@x>" and rows["<b@x>"].references == ["<z@x>", "<a@x>"] and rows["<b@x>"].body == "hi\n"
    assert rows["<b@x>"].date.hour == 8 and rows[None].date is None


def test_archives(spark, tmp_path):
    issue = {"number": 1, "title": "t", "state": "CLOSED", "updatedAt": "2024-01-02", "labels": ["a"], "comments": [{"author": "b", "body": "done"}]}
    (tmp_path / "a.json").write_text(json.dumps({"repo": "r", "issues": [issue, {"title": "no number"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"repo": "s"}))
    (row,) = mail.read_archives(spark, str(tmp_path)).collect()
    assert (row.repo, row.dropped, row.state, row.closedAt, row.comments[0].body) == ("r", 1, "closed", "2024-01-02", "done")
    assert mail.read_archives(spark, str(tmp_path), pulls=True).count() == 0


def test_vector_index(spark, tmp_path):
    rows = np.array([[1, -2], [3, 4]])
    tail = {"n": 2, "rfc": ["9000", "17a"], "off": [0, 10], "len": [10, 5], "sec": [1, -1], "title": [0, 0], "str": ["T", "7.2"]}
    (tmp_path / "0001.bin").write_bytes(vector_index.encoded(rows, 1, tail))
    got = vector_index.read_clusters(spark, str(tmp_path)).orderBy("off").collect()
    assert [(r.cluster_id, r.doc, r.section, r.title, r.code) for r in got] == [(1, "9000", "7.2", "T", [1, -2]), (1, "17a", None, "T", [3, 4])]
    with pytest.raises(vector_index.FormatError):
        vector_index.decoded(vector_index.encoded(rows)[:-1])
    with pytest.raises(vector_index.FormatError):
        vector_index.codec_scale({"vector_encoding": "int8"})
    assert vector_index.codec_scale({"vector_encoding": "int8", "vector_scale": "0.5"}) == 0.5
    (tmp_path / "c").mkdir()
    (tmp_path / "c/centroids.bin").write_bytes(vector_index.encoded(rows, magic=vector_index.CENTROIDS))
    assert vector_index.read_centroids(spark, str(tmp_path / "c")).count() == 2


def test_versions(spark, tmp_path):
    root = str(tmp_path / "corpus")
    for n in range(4):
        assert versions.publish(spark, root, {"chunks": spark.range(n + 1)}, {"model": "m"}, retain=2) == n + 1
    assert versions.versions(spark, root) == [3, 4]
    assert versions.current(spark, root, "chunks").count() == 4 and versions.metadata(spark, root)["build"] == "4"
    assert versions.compatible({"model": "m"}, {"model": "m"}) and not versions.compatible({"model": "m"}, {"model": "n"})


def test_stream_dedupe(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "message_id string, s long").withColumn("when", F.timestamp_seconds("s")).write.parquet(src)
    stream = spark.readStream.schema("message_id string, s long, when timestamp").parquet(src)
    q = streaming.deduplicated(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert sorted(r.message_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_stream_changed_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "stored")
    schema = "relpath string, text string"
    for n, text in enumerate(("one", "one", "two")):
        spark.createDataFrame([("f", text)], schema).write.mode("append").parquet(src)
        streaming.changed_files(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(out).count() == (1, 1, 2)[n]


def test_message_chunks(spark):
    text = "# Subject\nhead\n### [3] 2024-01-01 10:00 — Bob\nhello\n### [4] 2024-01-02 10:00 — Eve\nworld"
    got = chunking.message_chunks(spark.createDataFrame([(1, text)], "id int, text string")).select("chunk_idx", "part").collect()
    assert [r.chunk_idx for r in got] == [0, 3, 4] and got[2].part.endswith("world")


def test_dates(spark):
    rows = [("2024-01-02 03:04",), ("2024-01-02 03:04:05",), ("Tue, 2 Jan 2024 03:04:05 +0100",), ("nonsense",)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string").select(chunking.iso_date(F.col("d"))).collect()]
    assert got == ["2024-01-02T03:04:00Z", "2024-01-02T03:04:05Z", "2024-01-02T02:04:05Z", None]


def test_mmr_prefers_novelty(spark):
    rows = [("q", 1, 1.0, [1.0, 0.0]), ("q", 2, 0.99, [1.0, 0.0]), ("q", 3, 0.8, [0.0, 1.0])]
    got = search.mmr(spark.createDataFrame(rows, "query string, id long, score double, embedding array<double>"), 2).orderBy("place").collect()
    assert [r.id for r in got] == [1, 3]


def test_subject_clusters(spark):
    rows = [(1, "hello", "2024-01-01"), (2, "Re: hello", "2024-02-01"), (3, "Re: hello", "2024-06-01"), (4, "hello", "2024-06-02"), (5, "Re: hello", None)]
    df = spark.createDataFrame(rows, "id long, subject string, d string").select(F.lit("c").alias("corpus"), F.lit("hello").alias("key"), "id", "subject", F.to_timestamp("d").alias("date"), F.to_timestamp("d").alias("last"))
    got = {r.id: r.thread for r in threads.subject_clusters(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_descendants_stop_at_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4)], "parent long, child long")
    got = {(r.node, r.depth) for r in threads.descendants(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {(2, 1), (3, 2), (4, 2)}


def test_descendants_have_no_bound_on_rounds(spark, monkeypatch):
    monkeypatch.setattr(threads, "range", lambda *a: range(a[0], 4), raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(1, 3), (8, 1)], "parent long, child long")
    got = {(r.node, r.depth) for r in threads.descendants(edges, spark.createDataFrame([(1,)], "node long"), compact=3).collect()}
    assert got == {(2, 1)} | {(i, i - 2) for i in range(3, 10)}


def test_descendants_of_deep_chains_and_nested_roots(spark):
    edges = spark.range(1, 10_102).selectExpr("id AS parent", "id + 1 AS child").union(spark.createDataFrame([(-1, -2), (-2, -3), (-3, -1), (-3, -4), (-3, -4)], "parent long, child long"))
    roots = spark.createDataFrame([(1,), (10_095,), (-1,)], "node long")
    got = {(r.root, r.node): r.depth for r in threads.descendants(edges, roots).collect()}
    want = {(r, n): n - r for r in (1, 10_095) for n in range(r + 1, 10_103)}
    assert got == want | {(-1, -2): 1, (-1, -3): 2, (-1, -4): 3}


def test_ingest_order(spark):
    rows = [("c", 1, "a@x", "jane doe"), ("c", 2, "b@x", "jane doe"), ("c", 3, "b@x", "j d"), ("c", 4, "c@x", "")]
    got = {r.email: r.person for r in people.ingested(spark.createDataFrame(rows, "corpus string, seq long, email string, key string")).collect()}
    assert got["a@x"] == got["b@x"] != got["c@x"]


def test_logins(spark):
    p = spark.createDataFrame([(1, "jane@x.org", "jane doe"), (2, "bob@x.org", "bob roe")], "person long, email string, key string")
    a = spark.createDataFrame([("jane", None, ""), ("zz", "BOB@x.org", ""), ("yy", None, "jane doe"), ("none", None, "no one")], "login string, email string, key string")
    assert {r.login: r.person for r in people.login_links(p, a).collect()} == {"jane": 1, "zz": 2, "yy": 1, "none": None}


def test_grep_line_to_chunk_beyond_400_chunks(spark, tmp_path):
    from skein import catalogue

    text = "\n".join("a license" if i in (1, 5, 6, 2000, 2001, 4321) else "other" for i in range(1, 4322))
    rows = [(1, text), (2, text + "\n"), (3, ""), (4, "license"), (5, None), (6, "\n\nlicense\n\n")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in catalogue.QUERIES["grep_line_to_chunk"](spark, str(tmp_path)).select("file", "line", "chunk_idx").collect())
    want = [(i, k, (k - 1) // 5) for i, t in rows for k, line in enumerate((t or "").split("\n"), 1) if "license" in line]
    assert got == sorted(want)


def test_records_of_json_sources(spark, tmp_path):
    from skein.sources import records

    (tmp_path / "rfcs.json").write_text(json.dumps({"RFC200": {"title": "New", "obsoletes": ["RFC100"], "keywords": ["x"]}, "RFC100": {"title": "Old"}}))
    (tmp_path / "refs.json").write_text(json.dumps({"200": {"normative": ["100"], "informative": ["RFC0300"]}}))
    (tmp_path / "tags.json").write_text(json.dumps({"area": {"web": {"rfcs": ["RFC200", "RFC100"]}}}))
    got = records.read_rfc_index(spark, str(tmp_path))
    assert {r.name: r.obsoletes for r in got["rfcs"].collect()} == {"RFC200": ["RFC100"], "RFC100": None}
    assert {(r.src, r.dst, r.normative) for r in got["refs"].collect()} == {("RFC200", "RFC100", True), ("RFC200", "RFC300", False)}
    assert {(r.collection, r.tag, r.name) for r in got["tags"].collect()} == {("area", "web", "RFC200"), ("area", "web", "RFC100")}
    (tmp_path / "attendance.json").write_text(json.dumps([{"name": "Jane", "person": "p/1"}, {"name": "Bob"}]))
    assert {(r.name, r.person) for r in records.read_json(spark, str(tmp_path / "attendance.json"), "attendance").collect()} == {("Jane", "p/1"), ("Bob", None)}


def test_meeting_files(spark, tmp_path):
    from skein.operators import digests
    from skein.sources import records

    files = {"meetings/ietf1/minutes.md": "# M\nDate: 2024-01-02\nx", "meetings/ietf2/minutes.md": "no date", "meetings/ietf1/slides/a.pdf.txt": "s", "meetings/ietf1/transcripts/2024-01-02-1000.md": "# T", "meetings/_orphans/transcripts/2024-03-01-0930.md": "# Hall", "meetings/ietf1/polls.md": "p", "x.txt": "y"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = records.meeting_files(records.read_files(spark, str(tmp_path)))
    assert {(r.code, str(r.date)) for r in got["minutes"].collect()} == {("ietf1", "2024-01-02"), ("ietf2", "None")}
    rows = {r.title: (str(r.when), r.slides, r.transcripts) for r in digests.sessions(got["minutes"], got["slides"], got["transcripts"]).collect()}
    assert rows == {"IETF 1 meeting": ("2024-01-02 00:00:00", 1, ["meetings/ietf1/transcripts/2024-01-02-1000.md"]), "Hall": ("2024-03-01 09:30:00", 0, ["meetings/_orphans/transcripts/2024-03-01-0930.md"])}
    assert got["polls"].count() == 1


def test_leases_and_pointers(spark, tmp_path):
    from skein.sources import control

    store = control.Store(spark, str(tmp_path / "s"))
    assert control.acquire(store, "a", 10, now=100) and not control.acquire(store, "b", 10, now=105) and control.acquire(store, "a", 10, now=106)
    assert control.acquire(store, "b", 10, now=117) and control.holds(store, "b", now=118) and not control.holds(store, "a", now=118)
    control.release(store, "a")
    assert control.holds(store, "b", now=118)
    assert [control.acquire_slot(store, o, 10, 2, now=1) for o in "xyz"] == [0, 1, None]
    assert control.write_if_changed(store, "f", "1") and not control.write_if_changed(store, "f", "1") and control.write_if_changed(store, "f", "2")
    root = str(tmp_path / "v")
    for k in (1, 2, 3):
        assert control.publish(spark, root, {"t": spark.range(k)}, {"model": "m"}, "me") == k
    assert control.pointer(control.Store(spark, root)) == 3 and versions.versions(spark, root) == [2, 3]
    assert control.query_text("BAAI/bge-small-en-v1.5", "q").endswith("passages: q") and control.query_text("bge-small-zh", "q") == "q"


def test_one_of_interleaved_owners_holds_a_lease(spark, tmp_path, monkeypatch):
    """Every owner reads the state before any of them writes; also a state so old that its successors are gone."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from skein.sources import control

    store, gate, read = control.Store(spark, str(tmp_path / "s")), Barrier(4), control.Store.cell

    def together(self, name):
        got = read(self, name)
        gate.wait()
        return got

    for now in (0, 100, 200, 300, 400):  # free at first, then run out
        with monkeypatch.context() as m, ThreadPoolExecutor(4) as pool:
            m.setattr(control.Store, "cell", together)
            won = [o for o, ok in zip("abcd", pool.map(lambda o: control.acquire(store, o, 10, now=now), "abcd"), strict=True) if ok]
        assert len(won) == 1 and control.holds(store, won[0], now=now + 1)
    assert not store.swap(control.LEASE, 1, "{}") and not store.swap(control.LEASE, 4, "{}") and control.holds(store, won[0], now=401)
    assert store.numbers(control.LEASE) == [4, 5]


def test_a_pointer_moved_meanwhile_stays(spark, tmp_path, monkeypatch):
    from skein.sources import control

    root = str(tmp_path / "v")
    control.publish(spark, root, {"t": spark.range(1)}, {"model": "m"}, "me")
    stage = versions.publish

    def slow(*a, **k):
        control.Store(spark, root).swap(control.POINTER, 1, "77")
        return stage(*a, **k)

    monkeypatch.setattr(versions, "publish", slow)
    with pytest.raises(RuntimeError):
        control.publish(spark, root, {"t": spark.range(2)}, {"model": "m"}, "me")
    assert control.pointer(control.Store(spark, root)) == 77
    assert control.acquire(control.Store(spark, root), "another", 10)


def test_dumps_and_thread_files(spark):
    from skein.sources import records

    i = spark.createDataFrame([("r", 2, "b", "open", ["Bug"], None), ("r", 1, "a", "open", ["bug", "wontfix"], "x"), ("s", 3, "c", "closed", None, "y")], "repo string, number long, title string, state string, labels array<string>, body string")
    assert [r.text for r in records.issue_dump(i, ["BUG"], ["wontfix"]).collect()] == ["Issue #2: b\nState: open\n\n"]
    m = spark.createDataFrame([("t", "s", "Hi", 1, "2024-01-01", "Jane", None, "one"), ("t", "s", "Re: Hi", 2, "2024-01-02", "Bob", 1, "two")], "thread string, slug string, subject string, place int, date string, sender string, parent_place int, body string").withColumn("date", F.to_timestamp("date"))
    (row,) = records.thread_files(m).collect()
    assert row.relpath == "threads/s.md" and row.text.startswith("# Hi\n\n**Span:** 2024-01-01 → 2024-01-02\n**Messages:** 2\n\n## Messages\n\n### [1] 2024-01-01 00:00 — Jane\n\none\n\n### [2] 2024-01-02 00:00 — Bob (reply to [1])\n\ntwo")


def test_threads_merge_by_subject(spark):
    rows = [
        ("c", "a", "[x] Plan", "2024-01-01", None, [], "1"), ("c", "b", "Re: Plan", "2024-01-20", "a", [], "2"), ("c", "c", "RE: plan", "2024-02-20", "gone", [], "3"), ("c", "d", "Plan", "2024-02-21", None, [], "4"),
        ("c", "e", "Re: Plan", "2025-01-01", None, ["nope"], "5"), ("c", "f", "x", "2024-01-01", "g", [], "6"), ("c", "g", "x", "2024-01-01", "f", [], "7"), ("c", "h", "", "2024-01-01", None, [], "8"), ("c", "b", "Re: Plan", "2024-01-20", None, [], "0"),
    ]
    m = spark.createDataFrame(rows, "corpus string, message_id string, subject string, date string, in_reply_to string, references array<string>, path string").withColumn("date", F.to_timestamp("date"))
    got = {r.message_id: (r.parent_id, r.thread, r.place) for r in threads.assembled(m).collect()}
    assert got == {"a": (None, "a", 1), "b": ("a", "a", 2), "c": ("a", "a", 3), "d": (None, "d", 1), "e": (None, "e", 1)}


def test_index_rebuild(spark):
    asked = []

    def embed(texts):
        asked.extend(texts)
        return [[float(len(t))] for t in texts]

    def chunker(df):
        return chunking.windows(df, window=4, overlap=0).select("file", F.lit(0).alias("chunk_idx"), "sub_idx", F.col("window").alias("embed_text"))

    files = lambda rows: spark.createDataFrame(rows, "relpath string, text string").withColumn("sha256", F.sha2("text", 256))
    none = spark.createDataFrame([], "file string, chunk_idx int, sub_idx int, embed_text string, chunk_hash string, embedding array<double>")
    one, stamps = chunking.rebuilt(files([("a", "aaaabbbb"), ("b", "cccc"), ("d", "x")]), files([]).select("relpath", "sha256"), none, chunker, embed)
    one = spark.createDataFrame(one.collect(), one.schema)
    assert {(r.file, r.embed_text, r.embedding[0]) for r in one.collect()} == {("a", "aaaa", 4.0), ("a", "bbbb", 4.0), ("b", "cccc", 4.0), ("d", "x", 1.0)}
    known = one.withColumn("embedding", F.array(F.lit(9.0)))
    two, stamps = chunking.rebuilt(files([("a", "aaaadddd"), ("b", "cccc")]), spark.createDataFrame(stamps.collect(), stamps.schema), known, chunker, embed)
    assert {(r.file, r.embed_text, r.embedding[0]) for r in two.collect()} == {("a", "aaaa", 9.0), ("a", "dddd", 4.0), ("b", "cccc", 9.0)}
    assert stamps.filter("sha256 IS NULL").count() == 0


def test_registry_order(spark):
    mail_ = spark.createDataFrame([("c", 1, "jane@x.org", "jane doe"), ("c", 2, "bob@x.org", "bob roe"), ("c", 3, "jane@y.org", "jane doe")], "corpus string, seq long, email string, key string")
    github = spark.createDataFrame([("bob", None, "", False), ("Jane-Doe", None, "", False), ("Jo-Levy", None, "", False)], "login string, email string, key string, named boolean")
    facts = spark.createDataFrame([(1, "Chair", "jane@y.org", "x"), (2, "New One", "n@x.org", "new one"), (3, "New One", None, "new one")], "fact long, name string, email string, key string")
    seen = spark.createDataFrame([("m1", "bob roe"), ("m2", "nobody")], "meeting string, key string")
    got = people.registry(mail_, github, facts, facts, seen)
    who = {r.email: r.person for r in got["persons"].collect()}
    assert who["jane@x.org"] == who["jane@y.org"] != who["bob@x.org"]
    assert {r.login: r.person for r in got["links"].collect()} == {"bob": who["bob@x.org"], "Jane-Doe": who["jane@x.org"]}
    assert {(r.fact, r.person, r.known, r.group) for r in got["roles"].collect()} == {(1, who["jane@x.org"], True, None), (2, None, False, 2), (3, None, False, 2)}
    assert {(r.person, r.meetings) for r in got["meetings"].collect()} == {(who["bob@x.org"], 1)}


def test_seeds_and_hits(spark, tmp_path):
    from skein.sources import control

    seed, root = str(tmp_path / "seed"), str(tmp_path / "root")
    spark.range(5).write.parquet(f"{seed}/t")
    digest = control.table_digest(spark.range(5).orderBy(F.desc("id")))
    with pytest.raises(ValueError):
        control.install(spark, seed, root, {"t": "other"}, "me")
    assert control.pointer(control.Store(spark, root)) is None and control.install(spark, seed, root, {"t": digest}, "me") == 1
    rows = search.as_hits(spark.createDataFrame([("f", 1.5, " by A\n\n> yes ")], "file string, score double, rationale string")).collect()
    assert (rows[0].file, rows[0].score, rows[0].rationale, rows[0].url) == ("f", 1.5, "by A > yes", None)
