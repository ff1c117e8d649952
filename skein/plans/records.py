"""Queries of published records, and of text helpers that have a column form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import chunking as C
from skein.operators import digests as D
from skein.operators import people as P
from skein.operators import reads as R
from skein.operators import records
from skein.session import table

from .registry import query


def _rfcs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("RFC"), "p_partkey").alias("name"), F.col("p_name").alias("title"), F.array(F.lower("p_type")).alias("keywords"), F.col("p_brand").alias("status"), F.array(F.concat(F.lit("RFC"), F.expr("p_partkey div 2"))).alias("obsoletes"), F.array(F.concat(F.lit("RFC"), F.expr("p_partkey div 3"))).alias("updates"))


@query("SELECT 'RFC' || p_partkey AS name FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, 're'))) > 0 AND (starts_with(lower(p_type), 'econ') OR len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, 'econ'))) > 0)")
def record_search(spark: SparkSession, sf: str) -> DataFrame:
    return records.rfc_search(_rfcs(spark, sf), "re econ").select("name")


@query("""WITH b AS (SELECT 'RFC' || p_partkey // 2 AS dst, 'obsoleted by' AS kind, 'RFC' || p_partkey AS src FROM part UNION SELECT 'RFC' || p_partkey // 3, 'updated by', 'RFC' || p_partkey FROM part)
SELECT dst, kind, string_agg(src, ',' ORDER BY src) AS sources FROM b GROUP BY 1, 2""")
def record_relations(spark: SparkSession, sf: str) -> DataFrame:
    return records.relations(_rfcs(spark, sf)).withColumn("sources", F.array_join("sources", ","))


@query("""WITH m AS (SELECT o_orderkey AS milestone, o_custkey % 25 AS g, o_orderdate::DATE AS due, o_orderkey % 4 = 0 AS done, o_orderstatus AS s FROM orders), j AS (SELECT milestone, n_name AS acronym, due FROM m JOIN nation ON g = n_nationkey WHERE n_nationkey % 2 = 0 AND NOT done AND s = 'O')
SELECT milestone, acronym, due, (SELECT count(*) FROM j) AS total FROM j ORDER BY due, acronym, milestone LIMIT 50""")
def milestone_query(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "dropped").when(F.col("o_orderstatus") == "P", "review").otherwise("active")
    rows = o.select(F.col("o_orderkey").alias("milestone"), (F.col("o_custkey") % 25).cast("int").alias("group"), F.col("o_orderdate").cast("date").alias("due"), state.alias("state"), F.when(F.col("o_orderkey") % 4 == 0, "x").alias("resolved"))
    g = table(spark, sf, "nation").select(F.col("n_nationkey").alias("uri"), F.col("n_name").alias("acronym"), F.when(F.col("n_nationkey") % 2 == 0, "active").otherwise("conclude").alias("state"))
    return records.milestones(rows, g, F.lit("1997-01-01").cast("date")).select("milestone", "acronym", "due", "total")


@query("""SELECT l.l_orderkey AS id, l_linenumber AS n, o_custkey AS team, c_name AS team_name, s_name AS result_name, p_name AS person_name FROM lineitem l LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey""")
def review_joins(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    a = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_orderkey").alias("request"), F.col("l_suppkey").alias("result"), F.col("l_partkey").alias("reviewer"), F.col("l_shipdate").alias("assigned_on"), F.lit("").alias("reviewed_rev"))
    pick = lambda t, uri, **cols: table(spark, sf, t).select(F.col(uri).alias("uri"), *(F.col(v).alias(k) for k, v in cols.items()))
    requests = o.select(F.col("o_orderkey").alias("uri"), F.col("o_custkey").alias("team"))
    emails = table(spark, sf, "part").select(F.col("p_partkey").alias("uri"), F.col("p_partkey").alias("person"))
    out = records.review_record(a, requests, pick("customer", "c_custkey", team_name="c_name"), pick("supplier", "s_suppkey", result_name="s_name"), emails, pick("part", "p_partkey", person_name="p_name"))
    return out.select("id", "n", "team", "team_name", "result_name", "person_name")


@query("""WITH p AS (SELECT l_partkey AS doc, l_returnflag AS pos FROM lineitem) SELECT doc, count_if(pos = 'R') AS discusses FROM p GROUP BY 1 HAVING count_if(pos = 'R') > 0""")
def unresolved_discusses(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.when(F.col("l_returnflag") == "R", "discuss").otherwise("yes")
    return records.unresolved_discusses(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("doc"), pos.alias("pos")))


@query("""WITH a AS (SELECT l_partkey AS doc, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS authors FROM lineitem GROUP BY 1), c AS (SELECT l_partkey AS doc, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT p_partkey AS doc, authors, coalesce(n, 0) AS citations, p_size <> 7 AS active FROM part LEFT JOIN a ON a.doc = p_partkey LEFT JOIN c ON c.doc = p_partkey""")
def documents_summary(spark: SparkSession, sf: str) -> DataFrame:
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    out = records.documents_summary(
        p.select(F.col("p_partkey").alias("doc")), li.select(F.col("l_partkey").alias("doc"), F.col("l_suppkey").cast("string").alias("person")),
        li.filter("l_quantity > 40").select(F.col("l_partkey").alias("name")), p.filter("p_size = 7").select(F.col("p_partkey").alias("doc")),
    )
    return out.withColumn("authors", F.array_join("authors", ","))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 3 = 1) END AS seen FROM orders""")
def coverage_verdict(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    revs = F.when(k % 3 == 1, F.array(F.lit("00"), F.lit("01"))).when(k % 3 == 2, F.array(F.lit("00")))
    return table(spark, sf, "orders").select(k.alias("id"), records.coverage_of(revs, F.lit("01"), k % 5 == 0).alias("seen"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_size || '.2' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN 'B' ELSE '' END AS label FROM part""")
def section_labels(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    raw = F.when(size % 4 == 0, F.concat(F.lit("§"), size, F.lit(".2."))).when(size % 4 == 1, F.concat(F.lit("Section "), size)).when(size % 4 == 2, "appendix b").otherwise("see 3 below")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), R.section_label(raw).alias("label"))


@query("""SELECT o_orderkey AS id, list_filter([o_custkey, o_custkey + 1, 9000000077, 9000000099], lambda x: x <> o_orderkey) AS closes FROM orders""")
def closed_issues(spark: SparkSession, sf: str) -> DataFrame:
    o, n = table(spark, sf, "orders"), F.col("o_custkey")
    body = F.concat(F.lit("It closes: #"), n + 1, F.lit(", resolves #"), "o_orderkey", F.lit(", fix #"), n, F.lit(", closed other/repo#5, Resolved Me/Repo#9000000077; fixes https://github.com/me/repo/issues/9000000099 and https://github.com/me/repo2/issues/4, prefix #8, fixes the parser"))
    return o.select(F.col("o_orderkey").alias("id"), D.closes(F.concat(F.lit("Fixes #"), n), body, F.col("o_orderkey"), F.lit("me/repo")).alias("closes"))


@query("""WITH r AS (SELECT l_suppkey AS doc, CASE WHEN l_linenumber < 6 THEN '0' || l_linenumber ELSE '' END AS rev, l_returnflag <> 'N' AS done FROM lineitem), p AS (SELECT o_custkey % 100 AS doc, '0' || o_orderkey % 7 AS rev, CASE WHEN o_orderstatus = 'F' THEN 'Recuse' ELSE 'Yes' END AS pos FROM orders),
d AS (SELECT s_suppkey AS doc, CASE WHEN s_suppkey % 6 = 0 THEN 'x' ELSE '0' || s_suppkey % 9 END AS rev, s_suppkey % 11 > 0 AS reachable FROM supplier),
rr AS (SELECT doc, max(CASE WHEN done AND rev <> '' THEN rev::INT END) AS reviews, list(CASE WHEN done AND rev <> '' THEN rev::INT END) AS a, count_if(NOT done) AS unproductive FROM r GROUP BY 1), pp AS (SELECT doc, max(CASE WHEN pos = 'Yes' THEN rev::INT END) AS ballot, list(CASE WHEN pos = 'Yes' THEN rev::INT END) AS b FROM p GROUP BY 1),
j AS (SELECT d.doc, d.rev, reviews, ballot, coalesce(unproductive, 0) AS unproductive, reachable, try_cast(d.rev AS INT) AS now, list_filter(list_concat(coalesce(a, []), coalesce(b, [])), lambda x: x IS NOT NULL) AS seen FROM d LEFT JOIN rr USING (doc) LEFT JOIN pp USING (doc))
SELECT doc, rev, reviews, ballot, unproductive, CASE WHEN reachable AND now IS NOT NULL AND len(seen) > 0 THEN list_contains(seen, now) END AS current FROM j""")
def examined_revisions(spark: SparkSession, sf: str) -> DataFrame:
    li, o, s = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "supplier")
    reviews = li.select(F.col("l_suppkey").alias("doc"), F.when(F.col("l_linenumber") < 6, F.concat(F.lit("0"), "l_linenumber")).otherwise("").alias("rev"), (F.col("l_returnflag") != "N").alias("done"))
    positions = o.select((F.col("o_custkey") % 100).alias("doc"), F.concat(F.lit("0"), F.col("o_orderkey") % 7).alias("rev"), F.when(F.col("o_orderstatus") == "F", "Recuse").otherwise("Yes").alias("pos"))
    k = F.col("s_suppkey")
    return records.examined(reviews, positions, s.select(k.alias("doc"), F.when(k % 6 == 0, "x").otherwise(F.concat(F.lit("0"), k % 9)).alias("rev"), (k % 11 > 0).alias("reachable")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_custkey + 1 <> o_orderkey THEN o_custkey + 1 END AS duplicate_of, CASE WHEN o_orderstatus = 'F' THEN 'last' END AS rationale, CASE o_custkey WHEN 7 THEN [7, 3] WHEN 3 THEN [3, 7] ELSE [o_custkey, 7, 3] END AS people FROM orders""")
def issue_details(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    texts = F.array(F.concat(F.lit("Dup of #"), "o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("duplicate of #"), F.col("o_custkey") + 1)).otherwise("none"))
    return o.select(
        F.col("o_orderkey").alias("id"), D.duplicate_of(texts, F.col("o_orderkey")).alias("duplicate_of"),
        D.closing_rationale(F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN"), F.array(F.lit("first"), F.lit("last"))).alias("rationale"),
        D.first_seen(F.col("o_custkey"), F.array(F.lit(7).cast("long"), F.lit(3).cast("long"), F.lit(7).cast("long"))).alias("people"),
    )


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'jane doe' WHEN 1 THEN 'Jane Doe' ELSE 'x' END AS name, c_custkey % 3 = 2 OR c_custkey % 5 = 0 AS role, lower(c_mktsegment) AS org, lower('topic-' || c_mktsegment) AS slug FROM customer""")
def sender_details(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    sender = F.when(k % 3 == 0, "jane doe <j@example.org>").when(k % 3 == 1, '"Jane Doe" <j@example.org>').otherwise("<x@example.org>")
    address = F.when((k % 3 == 2) | (k % 5 == 0), "noreply@example.org").otherwise("replying@example.org")
    return table(spark, sf, "customer").select(k.alias("id"), X.sender_name(sender).alias("name"), P.is_role_account(address).alias("role"), P.org_key(F.concat("c_mktsegment", F.lit(", Inc."))).alias("org"), X.slug(F.concat(F.lit(" Topic: "), "c_mktsegment", F.lit("!"))).alias("slug"))


@query("""WITH d AS (SELECT n_nationkey AS id, ['example.org', 'mail.example.org', 'badexample.org'][(n_nationkey % 3 + 1)] AS d FROM nation) SELECT id, d <> 'badexample.org' AS inside FROM d""")
def domain_filter(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    d = F.element_at(F.array(F.lit("example.org"), F.lit("Mail.Example.org"), F.lit("badexample.org")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return n.select(F.col("n_nationkey").alias("id"), X.domain_within(d, "example.org").alias("inside"))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders""")
def iso_dates(spark: SparkSession, sf: str) -> DataFrame:
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss '+0000'"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), C.iso_date(form).alias("iso"))
