"""Decoded sources as typed tables (X10, X13 to X22): whatever fetched the files is none of this module's business.

A malformed file gives null columns or no rows, never a failure of the whole read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shapes of the JSON files, by source; those under MAPS are one object whose keys become the first column.
ARRAYS = {
    "attendance": "name string, person string",
    "ballot_events": "doc string, balloter string, pos string, time string, rev string, discuss string, comment string, ballot string",
    "group_events": "id string, group string, time string, desc string, rev string",
    "doc_events": "id string, doc string, time string, desc string, rev string",
    "catalog": "acronym string, name string, type string, state string, area string, description string, keywords array<string>",
    "groups": "acronym string, name string, type string, state string, parent string, resource_uri string, description string, list_email string",
    "areas": "acronym string, name string, resource_uri string",
    "charters": "name string, rev string, group string",
    "milestones": "id string, group string, desc string, due string, resolved string, state string, docs array<string>, time string",
    "assignments": "assigned_on string, completed_on string, result string, review_request string, reviewed_rev string, reviewer string, state string",
    "authors": "document string, person string, email string, affiliation string, country string, order int",
}
MAPS = {
    "rfcs": ("name", "struct<title: string, status: string, stream: string, level: string, wg: string, area: string, keywords: array<string>, obsoletes: array<string>, updates: array<string>>"),
    "refs": ("number", "struct<normative: array<string>, informative: array<string>>"),
    "documents": ("draft", "struct<expires: string, state: string>"),
}


def read_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One source: arrays of objects as rows, maps as rows with their key first."""
    if source in ARRAYS:
        return spark.read.option("multiLine", "true").schema(ARRAYS[source]).json(path)
    key, kind = MAPS[source]
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string, {kind}>")).alias(key, "_v"))
    return rows.select(key, "_v.*")


def read_rfc_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Rfcs (a row a document), refs (src, dst, normative; numbers and names alike) and tags (collection, tag, name)."""
    rfcs, refs = read_json(spark, f"{root}/rfcs.json", "rfcs"), read_json(spark, f"{root}/refs.json", "refs")
    name = lambda c: F.concat(F.lit("RFC"), F.regexp_replace(c, r"(?i)^rfc\s*0*|^0+", ""))
    edges = [refs.select(name(F.col("number")).alias("src"), F.explode(kind).alias("dst"), F.lit(kind == "normative").alias("normative")) for kind in ("normative", "informative")]
    edges = edges[0].unionByName(edges[1]).withColumn("dst", name(F.col("dst")))
    text = spark.read.text(f"{root}/tags.json", wholetext=True)
    tags = text.select(F.explode(F.from_json("value", "map<string, map<string, struct<rfcs: array<string>>>>")).alias("collection", "_m")).select("collection", F.explode("_m").alias("tag", "_t"))
    return {"rfcs": rfcs, "refs": edges, "tags": tags.select("collection", "tag", F.explode("_t.rfcs").alias("name"))}


def read_files(spark: SparkSession, root: str, pattern: str = "*", hidden: tuple[str, ...] = ("meetings/_orphans",)) -> DataFrame:
    """Relpath and text of the files below a folder, each whole; bytes that are no UTF-8 become replacement marks.

    hidden: folders that a listing leaves out, as their names begin with an underscore; those that exist are read too.
    """
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    more = [f"{root.rstrip('/')}/{h}" for h in hidden if fs.exists(path(f"{root.rstrip('/')}/{h}"))]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load([root, *more])
    folder = root.rstrip("/") + "/"
    relpath = F.substr("path", F.instr("path", folder) + F.lit(len(folder)))
    return files.select(relpath.alias("relpath"), F.decode("content", "UTF-8").alias("text"), F.contains("content", F.unhex(F.lit("00"))).alias("binary"))


def meeting_files(files: DataFrame) -> dict[str, DataFrame]:
    """Minutes (code, date, relpath), slides (code, relpath), transcripts (path, code, when, label) and polls (code, relpath, text) of files named by meeting."""
    parts = F.split("relpath", "/")
    m = files.filter(F.col("relpath").startswith("meetings/") & (F.size(parts) >= 3)).withColumn("code", parts[1])
    minutes = m.filter(F.col("relpath").rlike(r"^meetings/[^/]+/minutes\.md$") & (F.col("code") != "_orphans"))
    date = F.regexp_extract(F.substring("text", 1, 500), r"(?m)^Date:\s*(\d{4}-\d{2}-\d{2})", 1)
    slides = m.filter(F.col("relpath").rlike(r"^meetings/[^/]+/slides/[^/]+\.pdf\.txt$"))
    spoken = m.filter(F.col("relpath").rlike(r"^meetings/[^/]+/transcripts/[^/]+\.md$"))
    name, stamp = F.element_at(parts, -1), r"(\d{4}-\d{2}-\d{2})\D?(\d{2}):?(\d{2})"
    when = F.try_to_timestamp(F.concat(F.regexp_extract(name, stamp, 1), F.lit(" "), F.regexp_extract(name, stamp, 2), F.lit(":"), F.regexp_extract(name, stamp, 3)), F.lit("yyyy-MM-dd HH:mm"))
    title = F.regexp_extract("text", r"(?m)^# (.+)$", 1)
    return {
        "minutes": minutes.select("code", F.try_to_date(date, "yyyy-MM-dd").alias("date"), "relpath"), "slides": slides.select("code", "relpath"),
        "transcripts": spoken.select(F.col("relpath").alias("path"), F.when(F.col("code") != "_orphans", F.col("code")).alias("code"), when.alias("when"), F.when(title != "", title).alias("label")),
        "polls": m.filter(F.col("relpath").rlike(r"^meetings/[^/]+/polls[^/]*\.md$")).select("code", "relpath", "text"),
    }


def issue_dump(issues: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Issues with any of some labels and none of others, as one text a repository. issues: repo, number, title, state, labels, body."""
    from skein.sources.versions import bundles

    low = F.transform("labels", F.lower)
    has = lambda names: F.arrays_overlap(low, F.array(*[F.lit(n.lower()) for n in names]))
    rows = issues.filter(has(include)) if include else issues
    rows = rows.filter(~F.coalesce(has(exclude), F.lit(False))) if exclude else rows
    text = F.concat(F.lit("Issue #"), F.col("number").cast("string"), F.lit(": "), "title", F.lit("\nState: "), "state", F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return bundles(rows.withColumn("text", text), ["repo"], ["number"], rule="\n" + "=" * 72 + "\n")


def mail_years(messages: DataFrame) -> DataFrame:
    """Messages of each corpus and year (undated: 0) as one text in the order of dates. messages: corpus, date, message_id, subject, sender, body."""
    from skein.sources.versions import bundles

    text = F.concat(F.lit("From: "), "sender", F.lit("\nSubject: "), "subject", F.lit("\nDate: "), F.coalesce(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return bundles(messages.withColumn("year", F.coalesce(F.year("date"), F.lit(0))).withColumn("text", text), ["corpus", "year"], ["date", "message_id"], rule="\n" + "=" * 72 + "\n")


def thread_files(messages: DataFrame) -> DataFrame:
    """The readable file of each thread: subject, span, size, then its messages in order. messages: thread, slug, subject, place, date, sender, parent_place, body."""
    head = F.concat(F.lit("### ["), F.col("place").cast("string"), F.lit("] "), F.coalesce(F.date_format("date", "yyyy-MM-dd HH:mm"), F.lit("undated")), F.lit(" — "), "sender", F.when(F.col("parent_place").isNotNull(), F.concat(F.lit(" (reply to ["), F.col("parent_place").cast("string"), F.lit("])"))).otherwise(""))
    rows = messages.withColumn("_t", F.concat(head, F.lit("\n\n"), F.coalesce("body", F.lit(""))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_t"))), lambda x: x["_t"]), "\n\n")
    day = lambda f: F.coalesce(F.date_format(f("date"), "yyyy-MM-dd"), F.lit("undated"))
    out = rows.groupBy("thread", "slug").agg(F.min_by("subject", "place").alias("subject"), day(F.min).alias("a"), day(F.max).alias("b"), F.count("*").alias("n"), body.alias("body"))
    text = F.concat(F.lit("# "), "subject", F.lit("\n\n**Span:** "), "a", F.lit(" → "), "b", F.lit("\n**Messages:** "), F.col("n").cast("string"), F.lit("\n\n## Messages\n\n"), "body", F.lit("\n"))
    return out.select(F.concat(F.lit("threads/"), "slug", F.lit(".md")).alias("relpath"), text.alias("text"))
