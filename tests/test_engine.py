"""The query surface on a small store."""

import pytest
from pyspark.sql import functions as F

from skein.engine import Engine
from skein.operators import records


def vector(text: str) -> list[float]:
    words = text.lower().split()
    v = [sum(w.startswith(c) for w in words) + 0.01 for c in "abcd"]
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


@pytest.fixture(scope="module")
def engine(spark):
    texts = [("threads/one.md", 1, "alpha apple", "2024-01-01T00:00:00Z"), ("threads/one.md", 2, "bravo banana", "2024-01-02T00:00:00Z"), ("threads/two.md", 1, "charlie cat", None), ("drafts/draft-x-01.txt", 0, "delta dog apple", "2024-02-01T00:00:00Z"), ("drafts/draft-x-02.txt", 0, "delta dog apple", "2024-02-02T00:00:00Z")]
    rows = [("c", f, i, s, "T (Chair)", t, vector(t), d, "bug", "open", f"https://www.example.org/{f}/{i}/", "m1") for f, i, t, d in texts for s in (0, 1)]
    chunks = spark.createDataFrame(rows, "corpus string, file string, chunk_idx int, sub_idx int, title string, text string, embedding array<double>, chunk_date string, labels string, state string, url string, model string")
    messages = spark.createDataFrame([
        ("c", "<a>", None, "t1", "[x] hello", "Jane", "2024-01-01 00:00:00", "I support it. See draft-x-y-01 https://example.org/m/2", "https://example.org/m/1"),
        ("c", "<b>", "<a>", "t1", "Re: [x] hello", "Bob", "2024-01-02 00:00:00", "> I support it\n-1", "https://example.org/m/2"),
    ], "corpus string, message_id string, parent_id string, thread string, subject string, sender string, date string, body string, archived_at string").withColumn("date", F.to_timestamp("date"))
    tables = {
        "chunks": chunks, "messages": messages, "files": chunks.filter("sub_idx = 0").groupBy("corpus", F.col("file").alias("relpath")).agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text")),
        "corpora": spark.createDataFrame([("c", "m1")], "corpus string, model string"),
        "centroids": spark.createDataFrame([("c", "m1", 0, vector("a")), ("d", "m1", 1, vector("b")), ("e", "m2", 2, vector("c"))], "corpus string, model string, id int, embedding array<double>"),
        "issues": spark.createDataFrame([("c", "r", 1, "open", "2024-01-01", ["bug"]), ("c", "s", 1, "closed", "2024-01-03", ["bug", "doc"])], "corpus string, repo string, number long, state string, updated string, labels array<string>"),
        "threads": spark.createDataFrame([("c", "t1", 2, 2, "2024-01-02")], "corpus string, thread string, msgs long, participants long, last string").withColumn("last", F.to_timestamp("last")),
        "timeline": spark.createDataFrame([("c", "2024-01-01", "meeting", "m"), ("c", "2024-01-02", "draft", "d")], "corpus string, when string, kind string, title string"),
        "rfcs": spark.createDataFrame([("RFC100", "Old protocol", ["x"], [], [], "std"), ("RFC200", "New protocol", ["quic"], ["RFC100"], [], "std"), ("RFC300", "Other", [], [], ["RFC100"], "info")], "name string, title string, keywords array<string>, obsoletes array<string>, updates array<string>, status string"),
        "rfc_refs": spark.createDataFrame([("RFC300", "RFC100", False), ("RFC200", "100", True)], "src string, dst string, normative boolean"),
        "groups": spark.createDataFrame([("g1", "quic", "QUIC", "quic transport", "active", "wit", "Web", "wg")], "uri string, acronym string, name string, description string, state string, area string, area_name string, kind string"),
        "milestones": spark.createDataFrame([("g1", 1, "2020-01-01", "active", None), ("g1", 2, None, "active", None), ("g1", 3, "2021-01-01", "dropped", None)], "group string, milestone int, due string, state string, resolved string").withColumn("due", F.to_date("due")),
        "efforts": spark.createDataFrame([("tls", "Transport Layer Security", "crypto"), ("quic", "QUIC transport", "fast")], "acronym string, name string, about string"),
    }
    return Engine(spark, tables, vector)


def test_search(engine):
    got = engine.search_corpus("c", "alpha apple", limit=3).collect()
    assert (got[0].file, got[0].chunk_idx) == ("threads/one.md", 1)
    assert not {"drafts/draft-x-01.txt"} & {r.file for r in got if any(x.file == "drafts/draft-x-02.txt" for x in got)}
    assert [r.file for r in engine.search_corpus("c", "charlie", limit=1, diversify=False).collect()] == ["threads/two.md"]
    assert engine.search_corpus("c", "charlie", until="2024-01-01", diversify=False).count() == 0
    assert engine.search_corpus("c", "x", label="BUG", state="open", author="chair", diversify=False).count() >= 4
    assert engine.search_corpus("c", "alpha", group_by="file").collect()[0].hits == 2
    assert [r.chunk_date for r in engine.search_corpus("c", "x", sort="date", diversify=False, collapse_versions=False).collect()] == sorted([d for d in ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", "2024-02-01T00:00:00Z", "2024-02-02T00:00:00Z")], reverse=True)


def test_related_routing_and_merge(engine):
    assert (engine.find_related("c", "threads/one.md", 1).collect()[0].chunk_idx) == 0
    got = engine.which_corpus("alpha").collect()
    assert got[0].corpus == "c" and got[0].confident and {r.corpus for r in got} == {"c", "d"}
    assert engine.search_corpora(["c", "c"], "bravo", limit=2).collect()[0].id == "threads/one.md#2"
    assert engine.find_efforts("tra quic").collect()[0].acronym == "quic"


def revisions(spark, drafts: int, corpora: tuple[str, ...] = ("c",)):
    """Ten revisions of each draft, all alike but for a little."""
    rows = []
    for c in corpora:
        for d in range(drafts):
            for r in range(10):
                v = vector("alpha " * 3 + ("bravo " * (d % 7)))
                v[3] += 1e-4 * d + 1e-6 * r
                rows.append((c, f"drafts/draft-{d}-{r:02d}.txt", 0, 0, f"draft {d}", f"text {d} {r}", v, "2024-01-01", f"https://e.org/{d}/{r}", "1"))
    return spark.createDataFrame(rows, "corpus string, file string, chunk_idx int, sub_idx int, title string, text string, embedding array<double>, chunk_date string, url string, section string")


def test_limits_are_reached_after_thinning(spark):
    """Fetching for thinning is not bounded by what a caller may ask for, and what a caller asks for is."""
    few = Engine(spark, {"chunks": revisions(spark, 30)}, vector)
    for diversify in (True, False):
        got = few.search_corpus("c", "alpha", limit=30, diversify=diversify).collect()
        # 120 rows are fetched, of which each draft keeps the newest: so there are 12 drafts at least
        assert 12 <= len(got) <= 30 and len({r.title for r in got}) == len(got)
        assert [r.place for r in got] == sorted(r.place for r in got)
    every = Engine(spark, {"chunks": revisions(spark, 40).filter("file LIKE '%-09.txt'").unionByName(revisions(spark, 120).filter("file LIKE '%-08.txt'").withColumn("file", F.concat(F.lit("x"), "file")))}, vector)
    assert every.search_corpus("c", "alpha", limit=100).count() == 100 == every.search_corpus("c", "alpha", limit=1000, collapse_versions=False).count()
    assert len({r.place for r in every.search_corpus("c", "alpha", limit=100).collect()}) == 100
    assert every.search_corpus("c", "alpha", limit=-5).count() == 1
    related = every.find_related("c", "drafts/draft-0-09.txt", 0, limit=100).collect()
    assert len(related) == 100 and all(r.file != "drafts/draft-0-09.txt" for r in related)
    old = few.find_related("c", "drafts/draft-1-03.txt", 0, limit=40)
    assert old.groupBy("title").count().filter("count > 1").isEmpty()
    assert few.find_related("c", "drafts/draft-1-03.txt", 0, limit=5, group_by="file").collect()[0].hits == 1


def test_a_pool_without_all_its_vectors_keeps_its_order(spark):
    from skein.operators import search

    rows = [(c, f"f{i}", i, 0, 1.0 - i / 100, [float(i < 3), float(i >= 3)]) for c in ("c", "d") for i in range(6)]
    df = spark.createDataFrame(rows, "corpus string, file string, chunk_idx int, sub_idx int, score double, embedding array<double>")
    ranked = df.drop("embedding")
    got = {(r.corpus, r.place): r.chunk_idx for r in search.best_hits(ranked, 6, df.filter("NOT (corpus = 'd' AND chunk_idx = 5)").drop("score"), by_corpus=True).collect()}
    assert [got["d", k] for k in range(1, 7)] == list(range(6)) and [got["c", k] for k in range(1, 7)] != list(range(6)) and sorted(got["c", k] for k in range(1, 7)) == list(range(6))


def test_documents_rank_two_hundred_chunks(spark):
    c = revisions(spark, 30, ("rfc",)).withColumn("section", F.substring("file", -6, 2))
    engine = Engine(spark, {"chunks": c, "rfc_refs": spark.createDataFrame([("a", "draft-3-04")], "src string, dst string")}, vector)
    got = engine.search_rfc_text("alpha", limit=50)
    assert got["documents"].count() == 50 and got["sections"].filter("shown").count() == 50
    one = engine.search_rfc_text("alpha", rfc="draft-3-04")
    assert [r.doc for r in one["documents"].collect()] == ["draft-3-04"]


def test_merge_keeps_newest_revisions_of_each_corpus(spark):
    engine = Engine(spark, {"chunks": revisions(spark, 3, ("c", "d")), "corpora": spark.createDataFrame([("c", "m1"), ("d", "m2")], "corpus string, model string")}, vector)
    got = engine.search_corpora(["d", "c"], "alpha", limit=6).collect()
    assert [r.corpus for r in got] == ["d", "c"] * 3 and all(r.id.endswith("-09.txt#0") for r in got)
    assert engine.search_corpora(["c", "d"], "alpha", limit=40, collapse_versions=False).count() == 40


def test_reads(engine):
    assert engine.list_files("c", "THREADS/%").count() == 2
    assert engine.get_chunk_text("c", "threads/one.md", 1, 9).count() == 2
    assert engine.get_chunks_batch("c", [("threads/two.md", 1), ("none", 1)]).count() == 1
    assert engine.get_by_url("c", "http://example.org/threads/one.md/2#x").collect()[0].chunk_idx == 2
    assert engine.read_file_section("c", "threads/one.md", 2, 1).collect()[0].line_text == "bravo banana"
    assert engine.get_issue("c", 1).count() == 2 and engine.get_issue("c", 1, "r").count() == 1
    assert engine.grep_corpus("c", "APPLE").count() == 3 and engine.grep_corpus("c", "b.*a$", regex=True, files_only=True).count() == 1
    assert engine.grep_totals("c", "nothing").collect()[0].lines_hit == 0


def test_threads(engine):
    assert [r.message_id for r in engine.find_replies("c", "<a>").collect()] == ["<b>"]
    assert engine.find_citations("c", "draft-x-y").collect()[0].id == "<a>"
    assert [(r.src, r.dst, r.direction) for r in engine.find_message_citations("c", "<b>").collect()] == [("<a>", "<b>", "in")]
    tally = engine.tally_positions("c", "t1")
    assert {r.sender: r.label for r in tally["positions"].collect()} == {"Jane": "support", "Bob": "oppose"}
    assert [(r.msgs, r.support_high, r.oppose_high, r.withheld) for r in tally["summary"].collect()] == [(2, 1, 1, False)]


def test_digests(engine):
    assert engine.read_digest("c", "issues", state="closed").count() == 1
    assert [(r.label, r.n) for r in engine.read_digest("c", "labels").collect()] == [("bug", 2), ("doc", 1)]
    assert engine.read_digest("c", "timeline", exclude=("draft",)).count() == 1
    assert engine.list_labels("c").filter("source = 'subject'").collect()[0].label == "x"
    assert {k: v.count() for k, v in engine.overview("c").items()}["active threads"] == 1
    with pytest.raises(ValueError):
        engine.read_digest("c", "threads", label="x")
    with pytest.raises(KeyError):
        engine.list_drafts("c")


def test_filters_of_each_table(spark):
    people = spark.createDataFrame([("c", "Jane", ["Chair"], ["Acme", "Old"], ["mail.acme.org"], 5), ("c", "Bob", [], ["Old", "Acme"], ["x.org"], 9), ("c", "Eve", None, None, None, None)], "corpus string, name string, roles array<string>, orgs array<string>, domains array<string>, msgs long")
    threads = spark.createDataFrame([("c", "t1", "[mlkem] One", 3, "2024-01-02"), ("c", "t2", "Two", 30, "2024-01-01"), ("c", "t3", None, 1, None)], "corpus string, thread string, subject string, msgs long, last string")
    issues = spark.createDataFrame([("c", "r", 1, "OPEN", "2024-01-01", ["bug"], "Jane", 1), ("c", "r", 2, "merged", "2024-01-03", ["Doc"], "bob", 9), ("c", "r", 3, "closed", None, None, None, 2)], "corpus string, repo string, number long, state string, updated string, labels array<string>, author string, comments long")
    engine = Engine(spark, {"people": people, "threads": threads, "issues": issues, "pulls": issues})
    names = lambda df, c="name": [r[c] for r in df.collect()]
    assert names(engine.read_digest("c", "people")) == ["Bob", "Jane", "Eve"] and names(engine.read_digest("c", "people", role="chair")) == ["Jane"]
    assert names(engine.read_digest("c", "people", org="acme")) == ["Jane"] and names(engine.read_digest("c", "people", domain="acme.org")) == ["Jane"] and names(engine.read_digest("c", "people", least=6)) == ["Bob"]
    assert [tuple(r) for r in engine.people_note("c", 1, org="acme").collect()] == [(3, 1, 1, 1, 1)]
    assert names(engine.read_digest("c", "threads"), "thread") == ["t1", "t2", "t3"] and names(engine.read_digest("c", "threads", sort="activity"), "thread") == ["t2", "t1", "t3"] and names(engine.read_digest("c", "threads", subject="MLKEM"), "thread") == ["t1"]
    assert names(engine.read_digest("c", "issues"), "number") == [1, 2, 3] and names(engine.read_digest("c", "issues", sort="activity"), "number") == [2, 3, 1]
    assert names(engine.read_digest("c", "pulls", state="closed"), "number") == [2, 3] and names(engine.read_digest("c", "issues", author="BOB"), "number") == [2] and names(engine.read_digest("c", "issues", label="doc"), "number") == [2]
    with pytest.raises(ValueError):
        engine.read_digest("c", "documents", sort="activity")


def test_whole_files_and_unsectioned_chunks(spark):
    rows = [("c", "issues/1.md", i, 0, "t", f"part {i}", "https://e.org/i/1", None) for i in (2, 0, 1)] + [("c", "threads/a.md", 4, 0, "t", "one", "https://e.org/m", None), ("rfc", "RFC1.txt", 0, 0, "t", "lead", None, None), ("rfc", "RFC1.txt", 1, 0, "t", "more", None, None), ("rfc", "RFC1.txt", 2, 0, "t", "s", None, "1")]
    chunks = spark.createDataFrame(rows, "corpus string, file string, chunk_idx int, sub_idx int, title string, text string, url string, section string").withColumn("embedding", F.array(F.lit(1.0)))
    files = spark.createDataFrame([("c", "pulls/9.md", "pull text", "https://e.org/pull/9"), ("c", "threads/a.md", "x", "https://e.org/m")], "corpus string, relpath string, text string, url string")
    engine = Engine(spark, {"chunks": chunks, "files": files})
    got = engine.get_by_url("c", "http://www.e.org/i/1/").collect()
    assert [r.chunk_idx for r in got] == [0, 1, 2] and got[0].file_text == "part 0\npart 1\npart 2" and all(r.whole for r in got) and got[1].file_text is None
    assert [(r.chunk_idx, r.whole, r.text) for r in engine.get_by_url("c", "https://e.org/m").collect()] == [(4, False, "one")]
    assert [(r.file, r.file_text, r.whole) for r in engine.get_by_url("c", "https://e.org/pull/9").collect()] == [("pulls/9.md", "pull text", True)]
    assert [r.text for r in engine.get_rfc_section("RFC1", "").orderBy("first").collect()] == ["lead", "more"] and [r.text for r in engine.get_rfc_section("RFC1", "1").collect()] == ["s"]


def test_overview_and_schedule(engine, spark):
    more = {
        "drafts": spark.createDataFrame([("c", "draft-a", "00", "active"), ("c", "draft-a", "01", "active"), ("c", "draft-b", "00", "rfc")], "corpus string, draft string, rev string, state string"),
        "authorships": spark.createDataFrame([("draft-a", "Jane"), ("draft-a", "Bob")], "doc string, person string"), "citations": spark.createDataFrame([("c", "m1", "draft-b")], "corpus string, id string, name string"),
        "positions": spark.createDataFrame([("draft-a", "discuss"), ("draft-b", "yes")], "doc string, pos string"),
        "sessions": spark.createDataFrame([("m1", "b", "2024-07-01 09:30", "Asia/Tokyo", "1:30"), ("m1", "a", "2024-07-01 09:30", None, "02:00:00"), ("m2", "c", "x", None, "1:00")], "meeting string, code string, local string, zone string, duration string"),
        "issues": engine.tables["issues"].withColumn("title", F.lit("t")),
    }
    full = Engine(spark, engine.tables | more, vector)
    got = full.overview("c")
    assert set(got) == {"active threads", "recent", "labels", "open issues", "documents", "unresolved", "milestones"}
    assert [(r.doc, r.authors, r.citations, r.active) for r in got["documents"].collect()] == [("draft-a", ["Bob", "Jane"], 0, True), ("draft-b", None, 1, False)]
    assert [tuple(r) for r in got["unresolved"].collect()] == [("draft-a", 1)] and got["open issues"].count() == 1 and got["milestones"].count() == 2
    assert [(r.code, str(r.start), r.minutes) for r in full.meeting_schedule("m1").collect()] == [("b", "2024-07-01 00:30:00", 90), ("a", "2024-07-01 09:30:00", 120)]
    assert full.meeting_schedule().count() == 3


def test_topics_cut_long_messages(engine):
    got = engine.read_topic("c", "alpha apple", body_chars=1).collect()
    assert got and all(len(r.body) <= 101 for r in got)


def test_records(engine, spark):
    assert [r.name for r in engine.search_rfc_index("new pro").collect()] == ["RFC200"]
    assert [r.name for r in engine.search_rfc_index("rfc 100").collect()] == ["RFC100"]
    info = engine.get_rfc_info("RFC200")
    assert {(r.src, r.dst) for r in info["inbound"].collect()} == {("RFC300", "RFC100")} and [r.dst for r in info["outbound"].collect()] == ["RFC100"]
    assert [r.sources for r in engine.get_rfc_info("RFC100")["relations"].orderBy("kind").collect()] == [["RFC200"], ["RFC300"]]
    got = engine.list_milestones("2024-01-01").collect()
    assert [(r.milestone, r.status, r.total) for r in got] == [(1, "overdue", 2), (2, "open", 2)]
    assert engine.search_groups("quic", state="active").collect()[0].score == 111 or engine.search_groups("quic").count() == 1
    m = spark.createDataFrame([("2024-05-01", 5, "Asia/Tokyo"), ("2024-04-01", None, "UTC")], "first string, days int, zone string").withColumn("first", F.to_date("first"))
    assert records.upcoming(m, F.lit("2024-05-05 10:00:00").cast("timestamp")).count() == 1
    assert records.upcoming(m, F.lit("2024-05-05 20:00:00").cast("timestamp")).count() == 0


def test_documents_and_meetings(spark):
    text = "1.  Intro\n\nfirst words\n\n1.1.  More\n\nmore words\n\n2.  Next\n\nrest\n\nAuthors' Addresses\n\n   Jane Doe\n   Example Org\n   Email: jane@example.org\n"
    tables = {
        "drafts": spark.createDataFrame([("c", "draft-x", "00", "drafts/draft-x-00.txt"), ("c", "draft-x", "01", "drafts/draft-x-01.txt")], "corpus string, draft string, rev string, path string"),
        "files": spark.createDataFrame([("c", "drafts/draft-x-00.txt", "old"), ("c", "drafts/draft-x-01.txt", text)], "corpus string, relpath string, text string"),
        "meeting_files": spark.createDataFrame([("c", "m1", "minutes", "2024-01-01", "a"), ("c", "m2", "minutes", "2024-02-01", "b"), ("c", "m2", "polls", None, "p"), ("c", "m2", "slides", None, "s")], "corpus string, meeting string, kind string, date string, text string"),
        "reviews": spark.createDataFrame([("d", "00", True, "2024-01-01"), ("d", "", False, "2024-01-02")], "doc string, rev string, done boolean, assigned_on string"),
        "positions": spark.createDataFrame([("d", "02", "Recuse", "b")], "doc string, rev string, pos string, balloter string"),
        "draft_states": spark.createDataFrame([("d", "02")], "doc string, rev string"),
        "efforts": spark.createDataFrame([("tls", "Transport Layer Security", "crypto", "active"), ("quic", "QUIC transport", "fast", "conclude"), ("bravo", "Other", "none", "active")], "acronym string, name string, about string, state string"),
        "charters": spark.createDataFrame([("bravo", vector("bravo")), ("tls", vector("charlie"))], "acronym string, embedding array<double>"),
        "groups": spark.createDataFrame([("bravo", "Other", "x", "active", "a", "A", "wg")], "acronym string, name string, description string, state string, area string, area_name string, kind string"),
    }
    engine = Engine(spark, tables, vector)
    assert [(r.section, r.line) for r in engine.get_draft("c", "draft-x", outline=True).collect()] == [("1", 1), ("1.1", 5), ("2", 9)]
    assert engine.get_draft("c", "draft-x", section="1").collect()[0].text == "1.  Intro\n\nfirst words\n\n1.1.  More\n\nmore words\n"
    assert [r.line_text for r in engine.get_draft("c", "draft-x", start_line=3, max_lines=1).collect()] == ["first words"]
    assert [(r.place, r.name, r.organisation) for r in engine.draft_authors("c", "draft-x").collect()] == [(1, "Jane Doe", "Example Org")]
    assert [r.kind for r in engine.read_minutes("c").collect()] == ["minutes", "polls"] and engine.read_minutes("c", "m1").count() == 1
    (row,) = engine.get_reviews("d")["examined"].collect()
    assert (row.reviews, row.ballot, row.unproductive, row.current) == (0, None, 1, False)
    assert [r.acronym for r in engine.find_efforts("transport").collect()][:2] == ["tls", "quic"]
    assert engine.find_efforts("quic").collect()[0].acronym == "quic"
    assert engine.find_efforts("bravo banana").collect()[0].acronym == "bravo"
    assert engine.search_groups("bravo").collect()[0].acronym == "bravo"
