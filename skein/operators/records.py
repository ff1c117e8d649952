"""Published records, reviews, meetings and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.digests import milestone_status
from skein.operators.search import all_terms_prefix
from skein.operators.threads import descendants, inverted


def rfc_search(rfcs: DataFrame, query: str, status: str | None = None, stream: str | None = None, level: str | None = None, group: str | None = None) -> DataFrame:
    """An exact number names its record; else every word begins a word of the title or a keyword. rfcs: name, title, keywords, status, stream, level, wg."""
    number = "".join(c for c in query if c.isdigit())
    if number and query.lower().replace("rfc", "").strip() == number:
        found = rfcs.filter(F.col("name") == f"RFC{int(number)}")
    else:
        words = F.concat(F.split(F.lower("title"), r"[^a-z0-9]+"), F.transform("keywords", lambda k: F.lower(k)))
        found = all_terms_prefix(rfcs, query.lower().split(), words)
    for column, value in (("status", status), ("stream", stream), ("level", level), ("wg", group)):
        if value is not None:
            found = found.filter(F.lower(column) == value.lower())
    return found.orderBy("name")


def inbound(refs: DataFrame, rfcs: DataFrame, name: str) -> DataFrame:
    """What refers to a record or to one it obsoletes. refs: src, dst, normative; rfcs: name, obsoletes."""
    spark = refs.sparkSession
    edges = rfcs.select(F.col("name").alias("parent"), F.explode("obsoletes").alias("child"))
    own = spark.createDataFrame([(name,)], "node string")
    targets = own.unionByName(descendants(edges, own).select("node")).distinct()
    return refs.join(targets, refs["dst"] == targets["node"]).select("src", "dst", "normative").distinct()


def relations(rfcs: DataFrame) -> DataFrame:
    """Obsoleted and updated by: dst, kind, sources."""
    both = rfcs.select(F.col("name").alias("src"), F.explode("obsoletes").alias("dst"), F.lit("obsoleted by").alias("kind"))
    return inverted(both.unionByName(rfcs.select(F.col("name").alias("src"), F.explode("updates").alias("dst"), F.lit("updated by").alias("kind"))))


def outbound(refs: DataFrame, name: str) -> DataFrame:
    """What a record refers to; references that name no record go."""
    return refs.filter(F.col("src") == name).withColumn("dst", X.rfc_name(F.col("dst"))).filter("dst IS NOT NULL").select("dst", "normative").distinct()


def milestones(rows: DataFrame, groups: DataFrame, today: Column, status: str | None = "open", group: str | None = None, due_before=None, due_after=None, closed: bool = False, limit: int = 50) -> DataFrame:
    """M7: milestones beside their groups by due date (none last), with the number of all before the limit."""
    g = groups.select(F.col("uri").alias("group"), "acronym", F.col("state").alias("group_state"))
    out = rows.join(g, "group").withColumn("status", milestone_status(today))
    if not closed:
        out = out.filter(F.col("group_state") == "active")
    if status:
        out = out.filter(F.col("status").isin("open", "overdue") if status == "open" else F.col("status") == status)
    if group:
        out = out.filter(F.col("acronym") == group)
    if due_before is not None:
        out = out.filter(F.col("due") < due_before)
    if due_after is not None:
        out = out.filter(F.col("due") > due_after)
    total = out.agg(F.count("*").alias("total"))
    return out.orderBy(F.col("due").asc_nulls_last(), "acronym", "milestone").limit(limit).crossJoin(F.broadcast(total)).orderBy(F.col("due").asc_nulls_last(), "acronym", "milestone")


def review_record(assignments: DataFrame, requests: DataFrame, teams: DataFrame, results: DataFrame, emails: DataFrame, persons: DataFrame) -> DataFrame:
    """Five left joins on addresses, oldest first; an empty revision is null."""
    out = assignments
    for dim, key, cols in ((requests, "request", ["team"]), (teams, "team", ["team_name"]), (results, "result", ["result_name"]), (emails, "reviewer", ["person"]), (persons, "person", ["person_name"])):
        out = out.join(dim.select(F.col("uri").alias(key), *cols), key, "left")
    rev = F.when(F.col("reviewed_rev") != "", F.col("reviewed_rev"))
    return out.withColumn("reviewed_rev", rev).orderBy("assigned_on", "reviewer")


def coverage_of(revisions: Column, newest: Column, failed: Column) -> Column:
    """Whether the newest revision was looked at: true, false, or null where the source could not be read."""
    return F.when(failed, F.lit(None).cast("boolean")).otherwise(F.coalesce(F.array_contains(revisions, newest), F.lit(False)))


def examined(reviews: DataFrame, positions: DataFrame, documents: DataFrame) -> DataFrame:
    """For each document, which half of its record has looked at the current revision.

    reviews: doc, rev (null or empty: none named), done (whether a review came of it); positions: doc, rev, pos (a recuse
    is no look); documents: doc, rev, reachable (false: the source did not answer, so nothing is known). Returns doc, rev,
    reviews, ballot (newest revision examined by each; null: none), unproductive (assignments without a review), and
    current: true, false (something was examined, but not this revision), or null where nothing was or nothing is known.
    """
    number = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).cast("int"))
    r = reviews.withColumn("_n", F.when(F.col("done"), number("rev"))).groupBy("doc").agg(F.max("_n").alias("reviews"), F.collect_set("_n").alias("_a"), F.count_if(~F.col("done")).alias("unproductive"))
    p = positions.withColumn("_n", F.when(F.lower("pos") != "recuse", number("rev"))).groupBy("doc").agg(F.max("_n").alias("ballot"), F.collect_set("_n").alias("_b"))
    out = documents.join(r, "doc", "left").join(p, "doc", "left").withColumn("_now", number("rev"))
    none = F.array().cast("array<int>")
    seen = F.array_union(F.coalesce("_a", none), F.coalesce("_b", none))
    current = F.when(F.col("reachable") & F.col("_now").isNotNull() & (F.size(seen) > 0), F.array_contains(seen, F.col("_now")))
    return out.select("doc", "rev", "reviews", "ballot", F.coalesce("unproductive", F.lit(0)).cast("long").alias("unproductive"), current.alias("current"))


def upcoming(meetings: DataFrame, now: Column) -> DataFrame:
    """Meetings not over yet in the zone of their venue. meetings: first (date), days, zone."""
    today = F.to_date(F.from_utc_timestamp(now, F.col("zone")))
    return meetings.filter(F.date_add(F.col("first"), F.coalesce("days", F.lit(1)).cast("int")) > today).orderBy("first")


def repositories(candidates: DataFrame, limit: int = 10) -> DataFrame:
    """Five keys, each descending. candidates: repo, listed, drafts, mentions, stars, pushed."""
    return candidates.filter("listed OR drafts > 0 OR mentions > 0").orderBy(*(F.desc(c) for c in ("listed", "drafts", "mentions", "stars", "pushed")), "repo").limit(limit)


def documents_summary(documents: DataFrame, authors: DataFrame, citations: DataFrame, concluded: DataFrame) -> DataFrame:
    """Each document with its authors, citations and whether it is still active."""
    who = authors.groupBy("doc").agg(F.sort_array(F.collect_set("person")).alias("authors"))
    cited = citations.groupBy(F.col("name").alias("doc")).agg(F.count("*").alias("citations"))
    done = concluded.select("doc", F.lit(False).alias("_active")).distinct()
    out = documents.join(who, "doc", "left").join(cited, "doc", "left").join(done, "doc", "left")
    return out.withColumn("citations", F.coalesce("citations", F.lit(0))).withColumn("active", F.coalesce("_active", F.lit(True))).drop("_active")


def unresolved_discusses(positions: DataFrame) -> DataFrame:
    """Documents whose newest positions hold a DISCUSS, with their number."""
    return positions.groupBy("doc").agg(F.count_if(F.col("pos") == "discuss").alias("discusses")).filter("discusses > 0").orderBy("doc")


def themes(topics: DataFrame, most: int = 6) -> DataFrame:
    """The largest topics, generic ones behind the others."""
    return topics.orderBy("generic", F.desc("size"), "cluster").limit(most)


def both_directions(edges: DataFrame, node: Column) -> DataFrame:
    """Edges that start or end at a node."""
    return edges.filter(F.col("src") == node).withColumn("direction", F.lit("out")).unionByName(edges.filter(F.col("dst") == node).withColumn("direction", F.lit("in")))


def revision_spread(reviews: DataFrame) -> DataFrame:
    """How many looked at which revision. reviews: rev."""
    return reviews.groupBy("rev").agg(F.count("*").alias("n"))
