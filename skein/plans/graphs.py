"""Queries of threads, graphs and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.html import page_texts
from skein.functions.prose import elided_quotes as elided
from skein.functions.prose import snippets
from skein.functions.stances import positions
from skein.operators import threads as T
from skein.operators.people import name_keys
from skein.scratch import written
from skein.session import table
from skein.tables import MESSAGES, messages

from .registry import query


def _id() -> Column:
    return F.col("thread") * 1_000_000 + F.col("idx")


def _edges(m: DataFrame) -> DataFrame:
    return m.filter("parent IS NOT NULL").select((F.col("thread") * 1_000_000 + F.col("parent")).alias("parent"), _id().alias("child"))


@query(f"""WITH RECURSIVE {MESSAGES}, e AS (SELECT thread * 1000000 + parent AS parent, thread * 1000000 + idx AS child FROM messages WHERE parent IS NOT NULL),
d AS (SELECT thread * 1000000 AS root, thread * 1000000 AS node, 0 AS depth FROM messages WHERE idx = 0 UNION SELECT d.root, e.child, d.depth + 1 FROM d JOIN e ON d.node = e.parent)
SELECT root, node, min(depth)::INT AS depth FROM d WHERE depth > 0 GROUP BY 1, 2""")
def reply_descendants(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    return T.descendants(_edges(m), m.filter("idx = 0").select(_id().alias("node")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS parent, l_orderkey // 2 + 1 AS child FROM lineitem WHERE l_linenumber = 1 AND l_orderkey <> l_orderkey // 2 + 1),
d AS (SELECT DISTINCT parent AS root, parent AS node, 0 AS depth FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT d.root, e.child, d.depth + 1 FROM d JOIN e ON d.node = e.parent)
SELECT root, node, min(depth)::INT AS depth FROM d WHERE depth > 0 GROUP BY 1, 2""")
def obsoletes_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chains from the records that nothing obsoletes any more."""
    li = table(spark, sf, "lineitem")
    e = li.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("parent"), F.expr("l_orderkey div 2 + 1").alias("child")).filter("parent <> child").distinct()
    e = written(e, "edges")
    return T.descendants(e, e.select(F.col("parent").alias("node")).join(e.select(F.col("child").alias("node")), "node", "left_anti").distinct())


@query(f"""WITH {MESSAGES} SELECT thread, count(*) AS msgs, count(DISTINCT sender) AS participants, min(idx) AS first, max(idx) AS last FROM messages GROUP BY 1""")
def thread_summary(spark: SparkSession, sf: str) -> DataFrame:
    return T.summary(messages(spark, sf).withColumn("when", F.col("idx")))


@query(f"""WITH {MESSAGES}, c AS (SELECT thread, sender, count(*) AS n FROM messages GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY thread ORDER BY n DESC, sender) AS rank FROM c""")
def thread_participants(spark: SparkSession, sf: str) -> DataFrame:
    return T.participants(messages(spark, sf))


TOPIC = f"""WITH {MESSAGES}, m AS (SELECT thread * 1000000 + idx AS id, idx AS "when", thread FROM messages WHERE contains(body, 'ing the')), r AS (SELECT thread * 1000000 + idx AS id, idx AS "when" FROM messages WHERE idx > 0 AND thread IN (SELECT thread FROM m)),
n AS (SELECT id, "when" FROM r WHERE id NOT IN (SELECT id FROM m) ORDER BY "when" DESC, id LIMIT greatest(0, 60 - (SELECT count(*) FROM m)))"""


@query(f"""{TOPIC} SELECT id, "when", true AS matched FROM m UNION ALL SELECT id, "when", false FROM n""")
def topic_timeline(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).withColumn("id", _id())
    hit = m.filter(F.col("body").contains("ing the"))
    replies = m.filter("idx > 0").join(hit.select("thread").distinct(), "thread", "left_semi")
    return T.topic(hit.select("id", F.col("idx").alias("when")), replies.select("id", F.col("idx").alias("when")))


@query(f"""{TOPIC} SELECT thread, count(*) AS matched, any_value(s.n) AS msgs FROM m JOIN (SELECT thread AS t, count(*) AS n FROM messages GROUP BY 1) s ON s.t = m.thread GROUP BY thread""")
def thread_map(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    return T.thread_map(m.filter(F.col("body").contains("ing the")), m.groupBy("thread").agg(F.count("*").alias("msgs")))


@query("""SELECT l_partkey AS dst, l_returnflag AS kind, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS first FROM lineitem GROUP BY 1, 2""")
def ref_inversion(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    return T.inverted(refs).select("dst", "kind", F.size("sources").cast("long").alias("n"), F.element_at("sources", 1).alias("first"))


URL_SQL = r"https?://[^\s<>\"'')\]]+"
CANON = r"""'https://' || regexp_replace(lower(regexp_extract({u}, '^(?:[hH][tT][tT][pP][sS]?)://([^/?]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract({u}, '^(?:[hH][tT][tT][pP][sS]?)://[^/?]*(.*)$', 1), '/+$', '')"""
BARE = r"""regexp_replace(regexp_replace({u}, '#.*$', ''), '[).,;]+$', '')"""


def canon(u: str) -> str:
    return CANON.format(u=BARE.format(u=u))


LINKS = f"""found AS (SELECT page_id AS id, {canon("u[i]")} AS url, min(i - 1)::INT AS first FROM (SELECT page_id, regexp_extract_all(replace(html, 'href="/', 'href="' || regexp_extract(url, '^https?://[^/?#]+') || '/'), '{URL_SQL}') AS u FROM pages), range(1, len(u) + 1) r(i) GROUP BY 1, 2)"""


def _links(spark: SparkSession, sf: str) -> DataFrame:
    host = F.concat(F.lit('href="'), F.regexp_extract("url", r"^https?://[^/?#]+", 0), F.lit("/"))
    return T.links(table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.replace(F.col("html"), F.lit('href="/'), host).alias("text")))


@query(f"WITH {LINKS} SELECT * FROM found")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf)


@query(f"SELECT page_id, {canon('url')} AS url FROM pages")
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


JOINED = f"WITH {LINKS}, d AS (SELECT {canon('url')} AS url, max(page_id) AS target FROM pages GROUP BY 1), j AS (SELECT found.*, target FROM found LEFT JOIN d USING (url) WHERE target IS NULL OR target <> id)"


@query(f"{JOINED} SELECT id, url, first, target FROM j")
def link_join_left_outer(spark: SparkSession, sf: str) -> DataFrame:
    return T.linked(_links(spark, sf), table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")).select("id", "url", "first", "target")


@query(f"{JOINED} SELECT count_if(target IS NOT NULL) AS resolved, count_if(target IS NULL) AS external, count(DISTINCT id) AS pages FROM j")
def citation_counts(spark: SparkSession, sf: str) -> DataFrame:
    j = T.linked(_links(spark, sf), table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"))
    return j.agg(F.count_if(F.col("target").isNotNull()).alias("resolved"), F.count_if(F.col("target").isNull()).alias("external"), F.count_distinct("id").alias("pages"))


@query("""SELECT facet, value, count(*) AS n FROM (SELECT 'p_brand' AS facet, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part) GROUP BY 1, 2""")
def facet_tags(spark: SparkSession, sf: str) -> DataFrame:
    return T.facet_tags(table(spark, sf, "part"), ("p_brand", "p_type", "p_size"))


@query("""WITH m AS (SELECT user_id AS message_id, event_id AS path, CASE WHEN event_type = 'click' THEN event_id END AS reply FROM events)
SELECT message_id, path FROM m QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY reply IS NOT NULL DESC, path) = 1""")
def message_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    m = e.select(F.col("user_id").alias("message_id"), F.col("event_id").alias("path"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("in_reply_to"), F.array().cast("array<string>").alias("references"))
    return T.deduplicated(m).select("message_id", "path")


@query("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 100000 WHEN o_orderkey % 3 = 1 THEN o_orderkey - 1 END AS reply, [o_orderkey // 2, o_orderkey // 3, o_orderkey + 7000000] AS refs FROM orders),
r AS (SELECT id, arg_max(refs[i], i) AS last FROM m, range(1, 4) x(i) WHERE refs[i] IN (SELECT id FROM m) AND refs[i] <> id GROUP BY id)
SELECT m.id AS message_id, coalesce(CASE WHEN reply IN (SELECT id FROM m) AND reply <> m.id THEN reply END, last) AS parent_id FROM m LEFT JOIN r USING (id)""")
def thread_parents(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    reply = F.when(k % 3 == 0, k + 100000).when(k % 3 == 1, k - 1)
    m = o.select(k.alias("message_id"), reply.alias("in_reply_to"), F.array(F.expr("o_orderkey div 2"), F.expr("o_orderkey div 3"), k + 7000000).alias("references"))
    return T.with_parents(m).select("message_id", "parent_id")


@query()
def subject_threads(spark: SparkSession, sf: str) -> DataFrame:
    """T4, greedy and in order: no SQL. Orders of one customer are roots of one subject."""
    o = table(spark, sf, "orders")
    subject = F.concat(F.when(F.col("o_orderkey") % 3 > 0, "Re: ").otherwise(""), F.lit("topic "), F.col("o_custkey"))
    when = F.col("o_orderdate").cast("timestamp")
    roots = o.select(F.lit("c").alias("corpus"), X.subject(subject).alias("key"), F.col("o_orderkey").alias("id"), subject.alias("subject"), when.alias("date"), when.alias("last"))
    return T.subject_clusters(roots)


@query(r"""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Re: [' || lang || '] ' WHEN 1 THEN 'FWD: Aw: ' WHEN 2 THEN '[x] ' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS s FROM documents),
b AS (SELECT doc_id, s, regexp_replace(s, '^(?i)(?:\s*(?:(?:re|fwd|fw|aw|sv)\s*:|\[[^\]]*\]))+\s*', '') AS bare FROM s)
SELECT doc_id, CASE WHEN bare = '' THEN s ELSE bare END AS subject, regexp_matches(s, '^(?i)\s*(?:\[[^\]]*\]\s*)*(?:re|fwd|fw|aw|sv)\s*:') AS reply FROM b""")
def subject_normalise(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    s = F.concat(F.when(k == 0, F.concat(F.lit("Re: ["), "lang", F.lit("] "))).when(k == 1, "FWD: Aw: ").when(k == 2, "[x] ").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")))
    return d.select("doc_id", X.subject(s).alias("subject"), X.is_reply(s).alias("reply"))


@query(r"""WITH n AS (SELECT p_partkey, ' Draft-' || p_brand || '-' || lpad((p_size % 100)::VARCHAR, 2, '0') || CASE WHEN p_size % 2 = 0 THEN '.txt' ELSE '' END || ' ' AS n, CASE p_size % 3 WHEN 0 THEN 'rfc ' || p_size WHEN 1 THEN 'RFC0' || p_size ELSE 'x' || p_size END AS r FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(n)), '-\d{2}(?:\.txt)?$', ''), '\.txt$', '') AS draft, CASE WHEN r NOT LIKE 'x%' THEN 'RFC' || regexp_extract(r, '[1-9][0-9]*$') END AS rfc FROM n""")
def draft_name_normalise(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    size = F.col("p_size")
    n = F.concat(F.lit(" Draft-"), "p_brand", F.lit("-"), F.lpad((size % 100).cast("string"), 2, "0"), F.when(size % 2 == 0, ".txt").otherwise(""), F.lit(" "))
    r = F.when(size % 3 == 0, F.concat(F.lit("rfc "), size)).when(size % 3 == 1, F.concat(F.lit("RFC0"), size)).otherwise(F.concat(F.lit("x"), size))
    return p.select("p_partkey", X.draft_name(n).alias("draft"), X.rfc_name(r).alias("rfc"))


@query(r"""SELECT page_id, regexp_replace(replace(url, '://', '://me:pw' || page_id || '@'), '(https?://)[^/\s:@]+(?::[^/\s@]*)?@', '\1', 'g') AS url FROM pages""")
def redact_userinfo(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", X.redacted(F.replace(F.col("url"), F.lit("://"), F.concat(F.lit("://me:pw"), "page_id", F.lit("@")))).alias("url"))


@query()
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Nested elements are beyond SQL; tests hold it against a parser's tree on all pages."""
    return table(spark, sf, "pages").select("page_id", page_texts(F.col("html")).alias("text"))


@query()
def elided_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Line by line with state: no SQL."""
    m = messages(spark, sf)
    return m.select("thread", "idx", elided(F.concat(F.lit("> a\n> b\n\n> c\n"), "body", F.lit("\n-- \nme"))).alias("body"))


@query()
def message_positions(spark: SparkSession, sf: str) -> DataFrame:
    """A cascade of patterns with look-behind: no SQL."""
    m = messages(spark, sf)
    return m.select("thread", "idx", positions(F.concat(F.when(F.col("idx") % 3 == 0, "I support this, but ").when(F.col("idx") % 3 == 1, "Option 2\n").otherwise(""), "body")).alias("p")).select("thread", "idx", "p.label", "p.confidence", "p.choice")


@query()
def document_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Branches on the shape of a text: no SQL."""
    return table(spark, sf, "documents").select("doc_id", snippets(F.col("text")).alias("snippet"))


@query()
def person_name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Unicode folding: no SQL."""
    return table(spark, sf, "customer").select("c_custkey", name_keys(F.concat("c_name", F.lit(", Zoë (chair)"))).alias("key"))
