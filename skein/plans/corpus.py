"""Queries of chunkers, draft reads, thread assembly, timeline feeds and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import chunking as C
from skein.operators import digests as D
from skein.operators import people as P
from skein.operators import positions as V
from skein.operators import reads as R
from skein.operators import threads as T
from skein.session import table
from skein.tables import ISSUES, MESSAGES, issues, messages

from .registry import query

NL = "chr(10)"


def _feeds(text: str) -> str:
    return f"(length({text}) - length(replace({text}, {NL}, '')))"


@query(f"""WITH s AS (SELECT doc_id AS file, 0 AS chunk_idx, lang AS title, coalesce(text, '') AS body, doc_id % 7 AS base FROM documents),
n AS (SELECT *, CASE WHEN length(body) <= 1200 THEN 1 ELSE ceil((length(body) - 1200) / 1050)::BIGINT + 1 END AS parts FROM s),
w AS (SELECT *, k * 1050 AS low, substr(body, k * 1050 + 1, 1200) AS win FROM n, range(0, parts) r(k)), e AS (SELECT *, CASE WHEN k = 0 THEN length(body) ELSE low + length(win) END AS until FROM w)
SELECT file, k::INT AS sub_idx, CASE WHEN parts > 1 THEN title || ' (part ' || (k + 1) || '/' || parts || ')' ELSE title END AS title, base + {_feeds("substr(body, 1, low)")} AS start_line,
base + {_feeds("substr(body, 1, greatest(until - 1, 0))")} AS end_line, length(CASE WHEN k = 0 THEN body ELSE win END) AS chars, sha256(win) AS chunk_hash FROM e""")
def section_fragments(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    s = d.select(F.col("doc_id").alias("file"), F.lit(0).alias("chunk_idx"), F.col("lang").alias("title"), F.coalesce("text", F.lit("")).alias("body"), (F.col("doc_id") % 7).alias("start_line"))
    return C.section_chunks(s).select("file", "sub_idx", "title", "start_line", "end_line", F.length("text").alias("chars"), F.sha2("embed_text", 256).alias("chunk_hash"))


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(f"""SELECT doc_id AS id, lang || ',bug' AS labels, 'https://x.example/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS duplicate_of,
CASE WHEN doc_id % 3 > 0 THEN '_by ' || source || '_' || {NL} || {NL} || '> yes' END AS rationale, CASE WHEN doc_id % 3 > 0 THEN 'closed' ELSE 'open' END AS state FROM documents""")
def issue_headers(spark: SparkSession, sf: str) -> DataFrame:
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    text = _said(
        "# Issue #", k, ": title\n**URL:** https://x.example/", k, "  \n**State:** ", F.when(k % 3 > 0, "CLOSED").otherwise("Open"), "  \n**Labels:** ", F.upper("lang"), ", Bug , ,  \n",
        F.when(k % 2 == 0, _said("**Duplicate of:** #", k, "\n")).otherwise(""), F.when(k % 3 > 0, _said("**Closing rationale:**\n\n_by ", F.col("source"), "_\n\n> yes\n\n")).otherwise(""), "## Description\n\nbody",
    )
    return d.select(k.alias("id"), C.issue_header(text).alias("h")).select("id", "h.*")


PATHS = """p AS (SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'threads/t' || doc_id || '.md' WHEN 1 THEN 'Issues/i' || doc_id || '.MD' WHEN 2 THEN 'charters/c' || doc_id || '.md' WHEN 3 THEN 'drafts/Draft-' || lang || '-' || source || '-07.txt'
WHEN 4 THEN 'drafts/rfc' || doc_id || '.txt' ELSE 'x/charter.txt' END AS path, lang, source FROM documents)"""


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    path = F.when(k % 6 == 0, _said("threads/t", k, ".md")).when(k % 6 == 1, _said("Issues/i", k, ".MD")).when(k % 6 == 2, _said("charters/c", k, ".md")).when(k % 6 == 3, _said("drafts/Draft-", F.col("lang"), "-", F.col("source"), "-07.txt"))
    return table(spark, sf, "documents").select(k.alias("id"), path.when(k % 6 == 4, _said("drafts/rfc", k, ".txt")).otherwise("x/charter.txt").alias("path"), "lang", "source")


@query(f"""WITH {PATHS} SELECT id, CASE id % 6 WHEN 0 THEN 'thread' WHEN 1 THEN 'thread' WHEN 2 THEN 'charter' ELSE 'window' END AS chunker,
CASE id % 6 WHEN 3 THEN 'https://d.example/doc/draft-' || lang || '-' || source || '/' WHEN 5 THEN 'https://s.example/' || id END AS url FROM p""")
def file_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    text = _said("title\nSource: https://s.example/", F.col("id"), " \nbody")
    return _paths(spark, sf).select("id", C.chunker_of(F.col("path")).alias("chunker"), C.citation_url(F.col("path"), text, "https://d.example/doc").alias("url"))


@query("""WITH b AS (SELECT doc_id AS file, 100 + length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n, lang, source FROM documents WHERE regexp_matches(text, '\\S'))
SELECT file, 'Group ' || lang AS title, 'active' AS state, 'area:' || source || CASE WHEN file % 2 = 0 THEN ',type:wg' ELSE ',type:rg' END AS labels, 'https://s.example/' || file AS url FROM b""")
def charter_labels(spark: SparkSession, sf: str) -> DataFrame:
    d, k = table(spark, sf, "documents").filter(F.col("text").rlike(r"\S")), F.col("doc_id")
    text = _said("# Group ", F.col("lang"), "\nState: Active\nArea: Some Area (", F.upper("source"), ")\nType: ", F.when(k % 2 == 0, "Working").otherwise("Research"), " Group\nSource: https://s.example/", k, "\n\n", F.col("text"))
    return C.charter_chunks(d.select(k.alias("file"), text.alias("text"))).filter("sub_idx = 0").select("file", "title", "state", "labels", "url")


@query(f"""WITH d AS (SELECT doc_id AS file, unnest([0, 1, 2]) AS chunk_idx FROM documents) SELECT file, chunk_idx::INT AS chunk_idx, CASE chunk_idx WHEN 1 THEN 'record 1' ELSE '#' || (file + chunk_idx) || ': a title' END AS title,
CASE chunk_idx WHEN 0 THEN '2024-05-0' || (file % 9 + 1) || 'T10:00:00Z' END AS chunk_date FROM d""")
def issue_dump(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    text = _said("Issue #", k, ": a title \nDate: 2024-05-0", k % 9 + 1, " 10:00:00\n\nbody\n=====\nno issue\n=====\nx\nIssue #", k + 2, ": a title\n")
    return C.issue_records(table(spark, sf, "documents").select(k.alias("file"), text.alias("text"))).select("file", "chunk_idx", "title", "chunk_date")


HEADINGS = rf"""t AS (SELECT doc_id AS file, '1.  Intro ' || lang || {NL} || {NL} || coalesce(text, '') || {NL} || {NL} || '1.1.  Scope ' || {NL} || {NL} || '2.  Contents ...... 3' || {NL} || {NL} || 'A.  Nobody' || {NL} || {NL} || '2.  Body' || {NL} || ' ' || {NL} || '3.  Tight' || {NL} || 'x' || {NL} || {NL} || 'Appendix B.  Extra' || {NL} || {NL} || 'B.1.  More' AS text FROM documents),
l AS (SELECT file, i AS line, len(s) AS last_line, s[i] AS x, i = 1 OR regexp_matches(s[i - 1], '^\s*$') AS above, i = len(s) OR regexp_matches(s[i + 1], '^\s*$') AS below FROM (SELECT file, string_split(text, {NL}) AS s FROM t), range(1, len(s) + 1) r(i)),
m AS (SELECT *, regexp_extract(x, '{R.HEADING}', 1) AS word, regexp_extract(x, '{R.HEADING}', 2) AS section, regexp_extract(x, '{R.HEADING}', 3) AS title FROM l WHERE regexp_matches(x, '{R.HEADING}') AND above AND below),
h AS (SELECT file, line, section, title, last_line FROM m WHERE NOT regexp_matches(title, '{R.LEADER}') AND (NOT regexp_matches(section, '^[A-Z]$') OR word <> ''))"""


def _drafts(spark: SparkSession, sf: str) -> DataFrame:
    text = _said("1.  Intro ", F.col("lang"), "\n\n", F.coalesce("text", F.lit("")), "\n\n1.1.  Scope \n\n2.  Contents ...... 3\n\nA.  Nobody\n\n2.  Body\n \n3.  Tight\nx\n\nAppendix B.  Extra\n\nB.1.  More")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file"), text.alias("text"))


@query(f"WITH {HEADINGS} SELECT file, line::INT AS line, section, title, last_line::INT AS last_line FROM h")
def draft_headings(spark: SparkSession, sf: str) -> DataFrame:
    return R.headings(_drafts(spark, sf))


@query(f"""WITH {HEADINGS}, n AS (SELECT *, (section = '1' OR section LIKE '1.%') AS inside, coalesce(lead(line) OVER (PARTITION BY file ORDER BY line) - 1, last_line) AS nxt FROM h),
g AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line) AS gap FROM n), f AS (SELECT *, min(gap) OVER (PARTITION BY file) AS first FROM g WHERE inside),
s AS (SELECT file, min(line) AS a, max(nxt) AS b FROM f WHERE gap = first GROUP BY file) SELECT file, a::INT AS start, b::INT AS "end", sha256(array_to_string(string_split(text, {NL})[a:b], {NL})) AS text_hash FROM s JOIN t USING (file)""")
def draft_section(spark: SparkSession, sf: str) -> DataFrame:
    return R.draft_section(_drafts(spark, sf), "1").select("file", "start", "end", F.sha2("text", 256).alias("text_hash"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("file"), F.col("turn").alias("chunk_idx"), F.when(F.col("role") != "system", F.col("role")).alias("section"), F.coalesce("text", F.lit("")).alias("text"))


TURNS = "s AS (SELECT conv_id AS file, turn AS chunk_idx, nullif(role, 'system') AS section, coalesce(text, '') AS text FROM conversations)"


@query(f"""WITH {TURNS}, h AS (SELECT file, section, min(chunk_idx) AS hit FROM s WHERE contains(text, 'ing the') GROUP BY 1, 2)
SELECT s.file, s.section, hit, count(*) AS chunks, sha256(string_agg(text, {NL} ORDER BY chunk_idx)) AS text_hash FROM s JOIN h ON s.file = h.file AND s.section IS NOT DISTINCT FROM h.section AND chunk_idx >= hit GROUP BY 1, 2, 3""")
def passage_to_section_end(spark: SparkSession, sf: str) -> DataFrame:
    c = _turns(spark, sf)
    hits = c.filter(F.col("text").contains("ing the")).groupBy("file", "section").agg(F.min("chunk_idx").alias("chunk_idx"))
    return R.matched_passage(c, hits).select("file", "section", "hit", "chunks", F.sha2("text", 256).alias("text_hash"))


SCAN = rf"""{TURNS}, f AS (SELECT *, CASE WHEN section IS NULL OR section IS DISTINCT FROM lag(section) OVER (PARTITION BY file ORDER BY chunk_idx) THEN 1 ELSE 0 END AS n FROM s),
r AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY chunk_idx) AS run FROM f), j AS (SELECT file, any_value(section) AS section, min(chunk_idx) AS first, string_agg(text, {NL} ORDER BY chunk_idx) AS text FROM r GROUP BY file, run),
h AS (SELECT file, section, first, len(regexp_extract_all(text, 'ing\s+the'))::INT AS hits FROM j), g AS (SELECT * FROM h WHERE hits > 0)"""


@query(f"""WITH {SCAN}, p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY first) AS place, sum(hits) OVER (PARTITION BY file)::BIGINT AS in_file FROM g) SELECT file, section, first, place, hits, in_file, least(hits, 2)::INT AS shown FROM p WHERE place <= 3""")
def section_scan(spark: SparkSession, sf: str) -> DataFrame:
    return R.section_scan(_turns(spark, sf), r"ing\s+the")[0].drop("text")


@query(f"WITH {SCAN} SELECT count(DISTINCT file) AS files_hit, count(*) AS sections_hit, sum(hits)::BIGINT AS hits FROM g")
def section_scan_totals(spark: SparkSession, sf: str) -> DataFrame:
    return R.section_scan(_turns(spark, sf), r"ing\s+the")[1]


@query(f"""WITH RECURSIVE {MESSAGES}, m AS (SELECT thread || '.' || idx AS id, thread, idx, CASE WHEN parent IS NOT NULL THEN thread || '.' || parent END AS up FROM messages),
k AS (SELECT id, thread, idx, CASE WHEN up IN (SELECT id FROM m) AND up <> id THEN up END AS parent FROM m), d AS (SELECT id, id AS root, parent, idx FROM k WHERE parent IS NULL UNION ALL SELECT k.id, d.root, k.parent, k.idx FROM k JOIN d ON k.parent = d.id)
SELECT id AS message_id, parent AS parent_id, root AS thread, row_number() OVER (PARTITION BY root ORDER BY idx, id) AS place FROM d""")
def threads_assembled(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation has a subject of its own here; the merge of subjects, which is greedy, is tested apart."""
    m = messages(spark, sf)
    rows = m.select(
        F.lit("c").alias("corpus"), F.concat_ws(".", "thread", "idx").alias("message_id"), F.concat(F.lit("Re: topic "), "thread", F.lit(" "), F.when(F.col("parent").isNull(), F.col("idx")).otherwise(0)).alias("subject"),
        F.timestamp_seconds(F.col("idx") * 60).alias("date"), F.when(F.col("parent").isNotNull(), F.concat_ws(".", "thread", "parent")).alias("in_reply_to"), F.array().cast("array<string>").alias("references"), F.concat_ws("/", "thread", "idx").alias("path"),
    )
    return T.assembled(rows).select("message_id", "parent_id", "thread", "place")


@query("""WITH t AS (SELECT doc_id AS thread, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Re: [x] The ' || source || ': news!' ELSE '[x] A ' || repeat('very long ', 8) || lang END AS s, CASE WHEN doc_id % 5 > 0 THEN DATE '2024-01-01' + (doc_id % 4)::INT END AS first FROM documents),
b AS (SELECT *, CASE WHEN s = '' THEN 'no-subject' ELSE rtrim(substr(trim(regexp_replace(lower(regexp_replace(s, '^(?i)(?:Re: )?\\[x\\] ', '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-') END AS body FROM t),
g AS (SELECT thread, first, coalesce(strftime(first, '%Y-%m-%d'), 'undated') || '-' || body AS slug FROM b) SELECT thread, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY first NULLS FIRST, thread) AS n FROM g)""")
def thread_slugs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    subject = F.when(k % 3 == 0, "").when(k % 3 == 1, _said("Re: [x] The ", F.col("source"), ": news!")).otherwise(_said("[x] A ", "very long " * 8, F.col("lang")))
    first = F.when(k % 5 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 4).cast("int")))
    return T.slugs(table(spark, sf, "documents").select(k.alias("thread"), subject.alias("subject"), first.alias("first"))).select("thread", "slug")


@query(f"""WITH {MESSAGES}, c AS (SELECT thread, sender, count(*) AS n FROM messages GROUP BY 1, 2) SELECT thread, sender, n, row_number() OVER (PARTITION BY thread ORDER BY n DESC, sender) AS rank, CASE sender WHEN 'user' THEN 'Chair' END AS role, CASE sender WHEN 'user' THEN 'Example' WHEN 'assistant' THEN 'Other' END AS affiliation FROM c""")
def participants_tagged(spark: SparkSession, sf: str) -> DataFrame:
    people = spark.createDataFrame([("user", "Chair", "Example"), ("assistant", None, "Other")], "sender string, role string, affiliation string")
    return T.tagged_participants(messages(spark, sf), people)


@query("""WITH c AS (SELECT 'draft-' || lang || '-' || source AS draft, doc_id AS file, 0 AS chunk_idx FROM documents UNION ALL SELECT 'draft-x-' || source, doc_id, 1 FROM documents UNION ALL SELECT 'draft-y-' || doc_id % 7, doc_id, 1 FROM documents)
SELECT draft, count(*) AS places, count(DISTINCT file) AS files, min(file) AS file, arg_min(chunk_idx, file)::INT AS chunk_idx FROM c WHERE draft IS NOT NULL GROUP BY 1""")
def draft_citations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    text = _said("see Draft-", F.col("lang"), "-", F.col("source"), "-05 or draft-", F.col("lang"), "-", F.col("source"), "\n> draft-quoted-x\n### [1] a — b\n  > draft-quoted-y\ndraft-x-", F.col("source"), ", draft-y-", k % 7, ".\n", "draft-" + "long-" * 20 + "x")
    return T.citation_totals(T.cited_sections(table(spark, sf, "documents").select(k.alias("file"), text.alias("text"))))


SUBJECTS = """t AS (SELECT doc_id AS thread, CASE doc_id % 5 WHEN 0 THEN 'I-D Action: draft-' || lang || '-0' || doc_id % 10 || '.txt' WHEN 1 THEN 'Call for  Adoption and WGLC of ' || lang WHEN 2 THEN 'working group last call: ' || source WHEN 3 THEN 'Re: I-D Action: draft-x-01.txt' ELSE 'hello' END AS s,
CASE WHEN doc_id % 7 > 0 THEN DATE '2024-01-01' + (doc_id % 9)::INT END AS first, doc_id % 13 AS msgs, doc_id % 4 AS people FROM documents)"""


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    s = F.when(k % 5 == 0, _said("I-D Action: draft-", F.col("lang"), "-0", k % 10, ".txt")).when(k % 5 == 1, _said("Call for  Adoption and WGLC of ", F.col("lang"))).when(k % 5 == 2, _said("working group last call: ", F.col("source"))).when(k % 5 == 3, "Re: I-D Action: draft-x-01.txt").otherwise("hello")
    first = F.when(k % 7 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 9).cast("int")))
    return table(spark, sf, "documents").select(k.alias("thread"), s.alias("subject"), first.alias("first"), (k % 13).alias("msgs"), (k % 4).alias("participants"))


@query(f"""WITH {SUBJECTS} SELECT first AS "when", 'draft-published' AS kind, '`' || substr(s, 13, length(s) - 16) || '` published' AS title, thread FROM t WHERE thread % 5 = 0 AND first IS NOT NULL""")
def draft_publications(spark: SparkSession, sf: str) -> DataFrame:
    return D.publications(_subjects(spark, sf)).drop("detail")


@query(f"""WITH {SUBJECTS} SELECT first AS "when", CASE thread % 5 WHEN 1 THEN 'adoption-call' ELSE 'wglc' END AS kind, CASE thread % 5 WHEN 1 THEN 'Call for adoption thread starts: "' ELSE 'WG Last Call thread: "' END || s || '"' AS title, msgs || ' messages, ' || people || ' participants' AS detail, thread FROM t WHERE thread % 5 IN (1, 2) AND first IS NOT NULL""")
def procedural_events(spark: SparkSession, sf: str) -> DataFrame:
    return D.procedural(_subjects(spark, sf))


@query("""WITH m AS (SELECT 'ietf' || n_nationkey AS code, CASE WHEN n_nationkey % 3 > 0 THEN TIMESTAMP '2024-01-01' + to_days(n_nationkey::INT) END AS d FROM nation), s AS (SELECT 'ietf' || s_nationkey AS code, count(*) AS n FROM supplier GROUP BY 1),
t AS (SELECT 't' || lpad(c_custkey::VARCHAR, 9, '0') AS path, CASE WHEN c_custkey % 2 = 0 THEN 'ietf' || c_nationkey END AS code, CASE WHEN c_custkey % 11 > 0 THEN TIMESTAMP '2024-03-01' + to_hours((c_custkey % 50)::INT) END AS w FROM customer), u AS (SELECT * FROM t WHERE w IS NOT NULL),
j AS (SELECT code, count(*) AS n, min(path) AS p FROM u GROUP BY 1), k AS (SELECT d AS w, 'IETF ' || substr(code, 5) || ' meeting' AS title, coalesce(s.n, 0) AS slides, coalesce(j.n, 0) AS transcripts, j.p AS first FROM m LEFT JOIN s USING (code) LEFT JOIN j USING (code) WHERE d IS NOT NULL),
o AS (SELECT w, 'session (' || strftime(w, '%Y-%m-%d %H:%M') || ' UTC)' AS title, 0 AS slides, count(*) AS transcripts, min(path) AS first FROM u WHERE code IS NULL OR code NOT IN (SELECT code FROM m WHERE d IS NOT NULL) GROUP BY w)
SELECT w AS "when", title, slides, transcripts, first FROM k UNION ALL SELECT * FROM o""")
def meeting_sessions(spark: SparkSession, sf: str) -> DataFrame:
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    minutes = table(spark, sf, "nation").select(_said("ietf", n).alias("code"), F.when(n % 3 > 0, F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))).alias("date"))
    slides = table(spark, sf, "supplier").select(_said("ietf", F.col("s_nationkey")).alias("code"))
    when = F.when(c % 11 > 0, F.lit("2024-03-01").cast("timestamp") + F.make_interval(hours=(c % 50).cast("int")))
    spoken = table(spark, sf, "customer").select(F.concat(F.lit("t"), F.lpad(c.cast("string"), 9, "0")).alias("path"), F.when(c % 2 == 0, _said("ietf", F.col("c_nationkey"))).alias("code"), when.alias("when"), F.lit(None).cast("string").alias("label"))
    out = D.sessions(minutes, slides, spoken)
    return out.select("when", "title", "slides", F.coalesce(F.size("transcripts"), F.lit(0)).cast("long").alias("transcripts"), F.get("transcripts", F.lit(0)).alias("first"))


@query(f"""WITH {ISSUES}, i AS (SELECT repo, number, label AS title, author, state, updated - 10 AS created, CASE WHEN number % 3 = 0 THEN updated - 5 END AS closed, updated FROM issues)
SELECT created AS "when", 'issue-opened' AS kind, 'Issue #' || number || ' opened: "' || title || '"' AS title, 'by ' || author || ' (' || repo || ')' AS detail FROM i UNION ALL
SELECT coalesce(closed, updated), 'issue-closed', 'Issue #' || number || ' closed: "' || title || '"', '(' || repo || ')' FROM i WHERE state = 'closed'""")
def issue_events(spark: SparkSession, sf: str) -> DataFrame:
    i = issues(spark, sf)
    rows = i.select("repo", "number", F.concat(F.lit(" "), "label").alias("title"), F.col("author").cast("string").alias("author"), F.upper("state").alias("state"), F.date_sub("updated", 10).alias("created"), F.when(F.col("number") % 3 == 0, F.date_sub("updated", 5)).alias("closed"), "updated")
    return D.event_table([D.issue_events(rows)])


@query(f"WITH {ISSUES} SELECT repo, number, label AS title, updated FROM issues WHERE state = 'open' ORDER BY updated DESC, repo, number LIMIT 12")
def recent_open_issues(spark: SparkSession, sf: str) -> DataFrame:
    return D.recent_open(issues(spark, sf).withColumn("title", F.col("label")), 12)


@query("""WITH p AS (SELECT CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS org, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS domain, c_acctbal AS b FROM customer) SELECT count(*) AS total, count_if(org = 'BUILDING') AS matched, least(count_if(org = 'BUILDING'), 20) AS shown, count_if(org IS NULL) AS no_org, count_if(domain IS NULL) AS no_domain FROM p""")
def people_filter_note(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    p = table(spark, sf, "customer").select(F.when(c % 3 > 0, F.col("c_mktsegment")).alias("org"), F.when(c % 4 > 0, F.col("c_name")).alias("domain"))
    return D.people_note(p, F.col("org") == "BUILDING", 20)


@query("""WITH v AS (SELECT l_suppkey AS thread, l_partkey AS sender, l_orderkey * 10 + l_linenumber AS idx, CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'R' THEN '10' ELSE '9' END AS choice, CASE WHEN l_quantity > 25 THEN 'low' ELSE 'high' END AS confidence FROM lineitem WHERE l_linestatus = 'F'),
c AS (SELECT thread, choice, count(*) AS responses, count_if(confidence = 'low') AS low, count(DISTINCT sender) AS voters FROM v GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY thread ORDER BY choice = 'B', lpad(choice, 8, '0')) AS place FROM c""")
def poll_choices(spark: SparkSession, sf: str) -> DataFrame:
    return V.poll(_votes(spark, sf))


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    choice = F.when(F.col("l_returnflag") == "A", "B").when(F.col("l_returnflag") == "R", "10").otherwise("9")
    label = F.when(F.col("l_linestatus") == "F", "poll").otherwise("support")
    return li.select(F.col("l_suppkey").alias("thread"), F.col("l_partkey").alias("sender"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), choice.alias("choice"), F.when(F.col("l_quantity") > 25, "low").otherwise("high").alias("confidence"), label.alias("label"))


@query("""SELECT l_suppkey AS thread, l_partkey AS sender, arg_max(CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'R' THEN '10' ELSE '9' END, l_orderkey * 10 + l_linenumber) AS choice, count(*) AS times FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2""")
def poll_last_votes(spark: SparkSession, sf: str) -> DataFrame:
    return V.votes(_votes(spark, sf))


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 4 AS k FROM supplier) SELECT id, CASE k WHEN 0 THEN 'Chair/AD/Author of d1, d2' WHEN 1 THEN 'Editor of d9/Author of 3 drafts' WHEN 2 THEN NULL ELSE 'Secretary' END AS tag FROM s""")
def role_tags(spark: SparkSession, sf: str) -> DataFrame:
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey") % 4
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    roles = F.when(k == 0, arr("Area Director", "Chair")).when(k == 3, arr("Secretary")).otherwise(arr())
    return s.select(F.col("s_suppkey").alias("id"), P.role_tag(roles, F.when(k == 1, arr("d9", "d9")).otherwise(arr()), F.when(k == 0, arr("d2", "d1")).when(k == 1, arr("c", "b", "a")).otherwise(arr())).alias("tag"))


@query("""WITH c AS (SELECT c_custkey AS id, lower(replace(c_name, '#', '')) AS n, c_custkey % 6 AS k FROM customer) SELECT id, CASE WHEN k IN (0, 1, 4) THEN 'Jo ' || n END AS name, CASE k WHEN 0 THEN n || '@example.org' WHEN 1 THEN n || '@example.org' WHEN 2 THEN n || '@example.org' WHEN 3 THEN NULL WHEN 4 THEN NULL END AS email FROM c""")
def from_headers(spark: SparkSession, sf: str) -> DataFrame:
    c, k = table(spark, sf, "customer"), F.col("c_custkey") % 6
    n = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("")))
    h = F.when(k == 0, _said('"Jo ', n, '" <', F.upper(n), "@Example.org>")).when(k == 1, _said("Jo ", n, " via Datatracker <", n, "=40example.org@dmarc.ietf.org>")).when(k == 2, _said(" ", n, "@example.org ")).when(k == 3, "<noreply@ietf.org>").when(k == 4, _said("Jo ", n, " (IETF) <no-reply@mailman3.ietf.org>")).otherwise("")
    return c.select(F.col("c_custkey").alias("id"), P.from_header(h).alias("h")).select("id", "h.*")


@query("""WITH c AS (SELECT c_nationkey AS person, c_custkey % 5 AS k FROM customer), o AS (SELECT person, CASE WHEN k < 3 THEN 'university of x' WHEN k = 3 THEN 'acme' ELSE '128 technology' END AS key, k FROM c), g AS (SELECT person, key, count(*) AS n, count(DISTINCT k) AS variants, count_if(k = 2) AS plain FROM o GROUP BY 1, 2)
SELECT person, key, n, CASE key WHEN 'acme' THEN 'The Acme Technologies, Inc.' WHEN '128 technology' THEN '128 Technology' ELSE CASE WHEN plain > 0 THEN 'University of X' END END AS shown FROM g WHERE key <> 'university of x' OR plain > 0""")
def affiliations_shown(spark: SparkSession, sf: str) -> DataFrame:
    c, k = table(spark, sf, "customer"), F.col("c_custkey") % 5
    org = F.when(k < 2, "Univ. of X").when(k == 2, " University of X").when(k == 3, "The Acme Technologies, Inc.").otherwise("128 Technology")
    out = P.affiliations(c.select(F.col("c_nationkey").alias("person"), org.alias("org"), F.lit(None).cast("int").alias("year"), F.lit("draft").alias("source")))
    return out.filter("key <> 'university of x' OR shown = 'University of X'").select("person", "key", "n", "shown")


@query("""WITH p AS (SELECT s_suppkey AS person, 'jo ' || ['levy', 'smith', 'doe'][(s_suppkey % 3 + 1)] || CASE WHEN s_suppkey > 3 THEN ' ' || s_suppkey ELSE '' END AS key FROM supplier QUALIFY count(*) OVER (PARTITION BY key) = 1), l AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Jo-Levy' WHEN 1 THEN 'jo_smith' WHEN 2 THEN 'jodoe' WHEN 3 THEN 'Jo-Doe9' ELSE 'jo-DOE' END AS login FROM customer)
SELECT DISTINCT login, person FROM l JOIN p ON key = CASE login WHEN 'Jo-Levy' THEN 'jo levy' WHEN 'jo_smith' THEN 'jo smith' WHEN 'jo-DOE' THEN 'jo doe' END""")
def logins_by_name(spark: SparkSession, sf: str) -> DataFrame:
    s, c = F.col("s_suppkey"), F.col("c_custkey") % 5
    name = F.when(s % 3 == 0, "jo levy").when(s % 3 == 1, "jo smith").otherwise("jo doe")
    persons = table(spark, sf, "supplier").select(s.alias("person"), F.concat(name, F.when(s > 3, _said(" ", s)).otherwise("")).alias("key"))
    login = F.when(c == 0, "Jo-Levy").when(c == 1, "jo_smith").when(c == 2, "jodoe").when(c == 3, "Jo-Doe9").otherwise("jo-DOE")
    return P.logins_by_name(table(spark, sf, "customer").select(login.alias("login"), F.lit(False).alias("named")), persons).distinct()


@query("""SELECT s_suppkey AS person, count(DISTINCT o_orderdate) AS meetings, min(o_orderdate)::DATE AS first FROM orders JOIN supplier ON o_custkey % 500 = s_suppkey GROUP BY 1""")
def meeting_attendance(spark: SparkSession, sf: str) -> DataFrame:
    persons = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person"), _said("n ", F.col("s_suppkey")).alias("key"))
    return P.attended(table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("meeting"), _said("n ", F.col("o_custkey") % 500).alias("key")), persons)


@query("""WITH b AS (SELECT c_nationkey AS key, c_name AS entry, CASE WHEN c_custkey % 9 > 0 THEN lpad((c_custkey % 40)::VARCHAR, 3, '0') END AS f, 0 AS own, c_custkey AS k FROM customer UNION ALL SELECT s_nationkey, s_name, lpad((s_suppkey % 45)::VARCHAR, 3, '0'), 1, s_suppkey FROM supplier),
o AS (SELECT key, f, own, max(entry) AS entry FROM b GROUP BY 1, 2, 3) SELECT key, entry, f AS fetched_at FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(f, '') DESC, own DESC) = 1""")
def union_by_stamp(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda df: df.groupBy("key", "fetched_at").agg(F.max("entry").alias("entry"))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    remote = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("entry"), F.when(c % 9 > 0, F.lpad((c % 40).cast("string"), 3, "0")).alias("fetched_at"))
    local = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("entry"), F.lpad((s % 45).cast("string"), 3, "0").alias("fetched_at"))
    return P.united(one(remote), one(local))


@query("""WITH p AS (SELECT s_suppkey AS person, 'm' || s_suppkey AS email, 'n' || s_suppkey % 50 AS key FROM supplier), f AS (SELECT o_orderkey AS fact, 'm' || o_custkey AS email, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'n' || o_custkey % 70 END AS key FROM orders),
a AS (SELECT f.*, coalesce(p.person, q.person) AS person FROM f LEFT JOIN p USING (email) LEFT JOIN (SELECT key, min(person) AS person FROM p GROUP BY 1) q ON f.key = q.key), g AS (SELECT CASE WHEN key <> '' THEN key ELSE email END AS who, min(fact) AS grp FROM a WHERE person IS NULL GROUP BY 1)
SELECT fact, person, person IS NOT NULL AS known, CASE WHEN person IS NULL THEN grp END AS "group" FROM a LEFT JOIN g ON who = CASE WHEN a.key <> '' THEN a.key ELSE a.email END""")
def credited_facts(spark: SparkSession, sf: str) -> DataFrame:
    s, o, c = F.col("s_suppkey"), F.col("o_orderkey"), F.col("o_custkey")
    persons = table(spark, sf, "supplier").select(s.alias("person"), _said("m", s).alias("email"), _said("n", s % 50).alias("key"))
    return P.credited(persons, table(spark, sf, "orders").select(o.alias("fact"), _said("x", o).alias("name"), _said("m", c).alias("email"), F.when(o % 4 == 0, "").otherwise(_said("n", c % 70)).alias("key")))


THREAD_FILE = """t AS (SELECT doc_id AS file, doc_id % 3 AS k, lang, source FROM documents)"""


def _thread_files(spark: SparkSession, sf: str) -> DataFrame:
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    text = _said(
        "# Topic ", k, "\n**Labels:** ", F.upper("lang"), "\n\n## Messages\n\n### [1] 2024-05-0", k % 9 + 1, " 10:3", k % 10, " — Jane Doe (Chair)\n\n_Archived-At:_ https://m.example/", k, "\n\nhello\n",
        F.when(k % 3 == 0, "").otherwise(_said("### [2] undated — ", F.col("source"), " _(opened issue)_ (reply to [1])\nno header: ### [3]\n")), F.when(k % 3 == 2, "### [7] 2024-06-01 — Bob (reply to [2])\n\nbye").otherwise(""),
    )
    return d.select(k.alias("file"), text.alias("text"))


@query(f"""WITH {THREAD_FILE} SELECT file, 0 AS chunk_idx, NULL AS chunk_date, NULL AS sender, NULL AS role, NULL AS parent, 1 AS start_line, lower(lang) AS labels, NULL AS url FROM t
UNION ALL SELECT file, 1, '2024-05-0' || (file % 9 + 1) || 'T10:3' || file % 10 || ':00Z', 'Jane Doe', 'Chair', NULL, 6, lower(lang), 'https://m.example/' || file FROM t
UNION ALL SELECT file, 2, NULL, source, NULL, 1, 11, lower(lang), NULL FROM t WHERE k > 0 UNION ALL SELECT file, 7, '2024-06-01T00:00:00Z', 'Bob', NULL, 2, 13, lower(lang), NULL FROM t WHERE k = 2""")
def thread_file_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.thread_chunks(_thread_files(spark, sf)).select("file", "chunk_idx", "chunk_date", "sender", "role", "parent", "start_line", "labels", "url")


@query(f"WITH {THREAD_FILE} SELECT file, 1 AS parent, 2 AS child FROM t WHERE k > 0 UNION ALL SELECT file, 2, 7 FROM t WHERE k = 2")
def reply_graph(spark: SparkSession, sf: str) -> DataFrame:
    return C.reply_graph(_thread_files(spark, sf))


@query(f"""WITH c AS (SELECT conv_id AS file, turn AS chunk_idx, role AS title, coalesce(text, '') AS text, lpad(turn::VARCHAR, 4, '0') AS d FROM conversations),
f AS (SELECT file, arg_min(title, chunk_idx) AS title, max(d) AS last_active, substr(string_agg(text, {NL} ORDER BY chunk_idx), 1, 300) AS text FROM c GROUP BY file)
SELECT file, title, last_active, sha256(text) AS text_hash FROM f""")
def document_heads(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("chunk_idx"), F.lit(0).alias("sub_idx"), F.col("role").alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("chunk_date"), F.array(F.lit(1.0), F.col("turn").cast("double")).alias("embedding"))
    return C.document_vectors(rows, 300).select("file", "title", "last_active", F.sha2("text", 256).alias("text_hash"))


@query("""WITH o AS (SELECT o_orderkey AS code, o_orderdate::TIMESTAMP + to_hours((o_orderkey % 24)::INT) AS s, o_orderkey % 4 AS h FROM orders) SELECT code, s AS start, (h * 60 + 30)::INT AS minutes, s + to_minutes((h * 60 + 30)::INT) AS "end" FROM o""")
def session_times(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"))
    local = F.date_format(F.from_utc_timestamp(start, "Asia/Tokyo"), "yyyy-MM-dd HH:mm")
    return D.meeting_times(o.select(k.alias("code"), local.alias("local"), F.lit("Asia/Tokyo").alias("zone"), F.concat((k % 4).cast("string"), F.lit(":30")).alias("duration"))).select("code", "start", "minutes", "end")
