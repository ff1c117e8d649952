"""Mail threads, reply graphs and citations."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from skein.functions import text as X
from skein.operators.ranks import ahead, dealt, highest, placed
from skein.scratch import written

#: Longest silence that a subject bridges, matches and replies of a topic.
MERGE_DAYS, TOPIC_CAP = 60, 60


def deduplicated(messages: DataFrame) -> DataFrame:
    """One copy of each message id: one with a threading signal, else the first path."""
    signal = F.col("in_reply_to").isNotNull() | (F.size(F.coalesce("references", F.array().cast("array<string>"))) > 0)
    n = F.row_number().over(Window.partitionBy("message_id").orderBy(F.desc(signal), "path"))
    return messages.withColumn("_n", n).filter("_n = 1").drop("_n")


def with_parents(messages: DataFrame) -> DataFrame:
    """parent_id: In-Reply-To if known, else the last known reference."""
    known = messages.select(F.col("message_id").alias("_known")).distinct()
    refs = messages.select("message_id", F.posexplode_outer("references").alias("_pos", "_ref"))
    last = refs.join(known, F.col("_ref") == F.col("_known")).filter("_ref <> message_id").groupBy("message_id").agg(F.max_by("_ref", "_pos").alias("_last"))
    out = messages.join(last, "message_id", "left").join(known.withColumnRenamed("_known", "_direct"), F.col("in_reply_to") == F.col("_direct"), "left")
    return out.withColumn("parent_id", F.coalesce(F.when(F.col("_direct") != F.col("message_id"), F.col("_direct")), F.col("_last"))).drop("_last", "_direct")


def descendants(edges: DataFrame, roots: DataFrame, compact: int = 16) -> DataFrame:
    """Root, node, depth of everything below the roots, each once at its least depth. edges: parent, child.

    Rounds of joins until nothing new is found, so cycles end and chains may be of any depth. Where no node has two
    parents the steps double from round to round; else each round is one step. Each round is a table of its own, merged
    into one now and then, so plans stay small.
    """
    edges = written(edges.select("parent", "child").distinct(), "edges")
    found = front = written(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct(), "reached")
    if edges.groupBy("child").count().filter("count > 1").isEmpty():
        return _doubled(edges, found)
    for depth in count(1):
        step = front.join(edges, front["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        front = written(step.join(found.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if front.isEmpty():
            break
        found = found.unionByName(front)
        if depth % compact == 0:
            found = written(found, "reached")
    return found.filter("depth > 0")


def _doubled(edges: DataFrame, found: DataFrame) -> DataFrame:
    """`descendants` where a node has one parent: so it has one ancestor 2, 4, 8, ... steps up, and those links stay as few as the edges."""
    jumps, length = edges, 1
    while True:
        step = found.join(jumps, found["node"] == jumps["parent"]).groupBy("root", F.col("child").alias("node")).agg((F.min("depth") + F.lit(length)).alias("depth"))
        new = written(step.join(found.select("root", "node"), ["root", "node"], "left_anti"), "reached")
        if new.isEmpty():
            return found.filter("depth > 0")
        found = written(found.unionByName(new), "reached")
        below = jumps.select(F.col("parent").alias("_via"), F.col("child").alias("_child"))
        jumps, length = written(jumps.join(below, F.col("child") == F.col("_via")).select("parent", F.col("_child").alias("child")), "jumps"), length * 2


def _settled(clusters: list[list]) -> None:
    """Of open clusters, oldest first, those go that a newer one outlives: whatever they may take, it takes first."""
    while len(clusters) > 1 and clusters[-2][1] <= clusters[-1][1]:
        del clusters[-2]


class _Scan:
    """One range of a subject's dated roots, in order, from the range alone and the last date of all before it.

    Rows (kind 0) with the cluster they found or join; or, if that is of an earlier range, with the number of their chain.
    Then the clusters still open at the end (kind 1), oldest first, and the chains (kind 2).
    """

    def __init__(self, place: tuple, gap: int, latest: int | None):
        self.place, self.gap, self.latest, self.open, self.chains = place, gap, latest, [], []

    def taken(self, d: int, id_: object, z: int, reply: bool) -> tuple:
        latest, open_, chains, gap = self.latest, self.open, self.chains, self.gap
        founds = not reply or latest is None or d - latest > gap
        self.latest = z if latest is None else max(latest, z)
        while not founds and open_ and d - open_[-1][1] > gap:
            open_.pop()
        if founds or open_:
            if founds:
                open_.append([id_, z])
            open_[-1][1] = max(open_[-1][1], z)
            owner = open_[-1][0]
            _settled(open_)
            return (*self.place, 0, id_, owner, None, d, z)
        # a chain joins one earlier cluster: that lives at least as long as what the chain has brought it
        if not chains or d - chains[-1][2] > gap:
            chains.append([id_, d, z])
        chains[-1][2] = max(chains[-1][2], z)
        return (*self.place, 0, id_, None, len(chains) - 1, d, z)

    def ended(self) -> list[tuple]:
        return [(*self.place, 1, c, c, k, None, z) for k, (c, z) in enumerate(self.open)] + [(*self.place, 2, c, None, k, d, z) for k, (c, d, z) in enumerate(self.chains)]


def _scanned(batches: Iterator[pa.RecordBatch], gap: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Range after range of a task, as a stream: only a range's open clusters and chains are kept. Of a range with a date before it, that row (without a date of its own) comes first."""
    scan = None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        out = []
        for corpus, key, p, d, id_, z, reply, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if scan is None or scan.place != (corpus, key, p):
                out += scan.ended() if scan else []
                scan = _Scan((corpus, key, p), gap, before)
            if d is not None:
                out.append(scan.taken(d, id_, z, reply))
        if out:
            yield made(out)
    if scan and (out := scan.ended()):
        yield made(out)


def _resolved(t: pa.Table, gap: int, schema: pa.Schema) -> pa.Table:
    """The clusters that a subject's chains join, range after range. t: kinds 1 and 2 of `_scanned`."""
    open_, out = [], []
    for r in sorted(t.to_pylist(), key=lambda r: (r["_p"], -r["kind"], r["n"])):
        if r["kind"] == 2:
            while r["d"] - open_[-1][1] > gap:  # one is always open: else the chain's first row had founded a cluster
                open_.pop()
            open_[-1][1] = max(open_[-1][1], r["z"])
            out.append({c: r[c] for c in ("corpus", "key", "_p", "n")} | {"into": open_[-1][0]})
        else:
            open_.append([r["id"], r["z"]])
        _settled(open_)
    return pa.Table.from_pylist(out, schema=schema)


def subject_clusters(roots: DataFrame) -> DataFrame:
    """T4: roots of one subject joined to conversations: id, thread. roots: corpus, key, id, subject, date (timestamp or null), last.

    Only a root with a reply prefix joins an earlier conversation, the newest whose last message is at most MERGE_DAYS
    before it; without dates the newest. `last` is not before `date`.

    Whether a root founds a conversation depends on the last date of all roots before it only, so it is known at once.
    Ranges of a subject's time are then scanned side by side; what a scan can't say, which older conversation a root joins, it
    leaves as a few chains, which a second pass over the ranges' ends resolves. So a subject with half of all roots takes
    as many tasks as it fills.
    """
    gap, keys = MERGE_DAYS * 86_400_000_000, ["corpus", "key"]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = roots.select(*keys, "id", micros("date").alias("d"), F.greatest(micros("date"), micros("last")).alias("z"), X.is_reply(F.col("subject")).alias("reply"))
    dated = dealt(rows.filter("d IS NOT NULL"), keys, [F.col("d"), F.col("id")], "subject-roots")
    kinds = dict(roots.dtypes)
    schema = f"corpus {kinds['corpus']}, key {kinds['key']}, _p int, kind int, id {kinds['id']}, owner {kinds['id']}, n int, d long, z long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    cols = [*keys, "_p", "d", "id", "z", "reply"]
    before = ahead(dated, keys, "z").filter("_before IS NOT NULL")
    ranges = dated.select(*cols).unionByName(before, allowMissingColumns=True).repartition(*keys, "_p").sortWithinPartitions(*cols[:5])
    scanned = ranges.select(*cols, "_before").mapInArrow(lambda batches: _scanned(batches, gap, arrow), schema)
    scanned = written(scanned, "subject-scan")
    joins = f"corpus {kinds['corpus']}, key {kinds['key']}, _p int, n int, into {kinds['id']}"
    into_schema = to_arrow_schema(_parse_datatype_string(joins))
    chains = scanned.filter("kind = 2").select(*keys).distinct()
    ends = scanned.filter("kind > 0").join(chains, keys, "left_semi")
    into = ends.groupBy(*keys).applyInArrow(lambda t: _resolved(t, gap, into_schema), joins)
    found = scanned.filter("kind = 0")
    out = found.filter("owner IS NOT NULL").select("id", F.col("owner").alias("thread")).unionByName(found.filter("owner IS NULL").join(into, [*keys, "_p", "n"]).select("id", F.col("into").alias("thread")))
    # those without a date come last: they join the newest conversation, whatever its dates
    undated = rows.filter("d IS NULL").select(*keys, "id", "reply")
    newest = found.filter("id = owner").groupBy(*keys).agg(F.max_by("id", F.struct("d", "id")).alias("_base"))
    first = undated.groupBy(*keys).agg(F.min("id").alias("_first"))
    undated = undated.join(newest, keys, "left").join(first, keys).withColumn("_founds", ~F.col("reply") | (F.col("_base").isNull() & (F.col("id") == F.col("_first"))))
    undated = highest(undated.withColumn("_own", F.when(F.col("_founds"), F.col("id"))), keys, [F.col("id")], "_own", "_before_it")
    return out.unionByName(undated.select("id", F.coalesce("_own", "_before_it", "_base").alias("thread")))


def summary(messages: DataFrame) -> DataFrame:
    """Messages, participants, first and last of each thread."""
    return messages.groupBy("thread").agg(F.count("*").alias("msgs"), F.count_distinct("sender").alias("participants"), F.min("when").alias("first"), F.max("when").alias("last"))


def participants(messages: DataFrame) -> DataFrame:
    """Senders of each thread by number of messages, then name."""
    return messages.groupBy("thread", "sender").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("n"), "sender")))


def topic(matched: DataFrame, replies: DataFrame, cap: int = TOPIC_CAP) -> DataFrame:
    """All matches and the newest replies, at most `cap` in all. Both: id, when."""
    n = matched.distinct().count()
    newest = replies.join(matched.select("id"), "id", "left_anti").distinct().orderBy(F.desc("when"), "id").limit(max(0, cap - n))
    return matched.distinct().withColumn("matched", F.lit(True)).unionByName(newest.withColumn("matched", F.lit(False))).orderBy("when", "id")


def links(pages: DataFrame, pattern: str = X.URL) -> DataFrame:
    """Distinct canonical addresses that a text names, with their first place. pages: id, text."""
    urls = pages.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "url"))
    return urls.groupBy("id", X.canonical_url(F.col("url")).alias("url")).agg(F.min("pos").alias("first"))


def linked(found: DataFrame, dimension: DataFrame) -> DataFrame:
    """Addresses resolved to ids, null if they lead outside; self-links go. dimension: id, url, and `seq`: the last of an address's rows wins (without seq, the greatest id)."""
    last = F.max_by("id", F.struct("seq", "id")) if "seq" in dimension.columns else F.max("id")
    target = dimension.groupBy(X.canonical_url(F.col("url")).alias("url")).agg(last.alias("target"))
    return found.join(target, "url", "left").filter(F.col("target").isNull() | (F.col("target") != F.col("id")))


def citations(texts: DataFrame) -> DataFrame:
    """Names cited on lines that aren't quoted, once a text. texts: id, text."""
    own = F.regexp_replace("text", r"(?m)^\s*>.*$", "")
    names = texts.select("id", F.explode(F.regexp_extract_all(F.lower(own), F.lit(X.DRAFT_NAME), F.lit(0))).alias("name"))
    return names.select("id", X.draft_name(F.col("name")).alias("name")).distinct()


def inverted(refs: DataFrame) -> DataFrame:
    """Dst with the sorted distinct src of each relation. refs: src, dst, kind."""
    return refs.groupBy("dst", "kind").agg(F.sort_array(F.collect_set("src")).alias("sources"))


def thread_map(matched: DataFrame, sizes: DataFrame) -> DataFrame:
    """Matched messages of each thread beside its size."""
    return matched.groupBy("thread").agg(F.count("*").alias("matched")).join(sizes, "thread", "left")


def facet_tags(rfcs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Tag and number of records for each value of some columns."""
    pairs = ", ".join(f"'{c}', CAST({c} AS STRING)" for c in columns)
    tags = rfcs.select(F.expr(f"stack({len(columns)}, {pairs}) AS (facet, value)")).filter("value IS NOT NULL")
    return tags.groupBy("facet", "value").agg(F.count("*").alias("n"))


def strip_quotes(body: Column) -> Column:
    """V3: without quoted lines."""
    return F.regexp_replace(body, r"(?m)^\s*>.*\n?", "")


def forest(messages: DataFrame) -> DataFrame:
    """All messages, once each, with parent_id, root (null for those that only reply to one another), key (of the root's subject), and
    thread and place where they belong to a conversation. messages: as of `assembled`."""
    m = written(with_parents(deduplicated(messages)), "thread-messages")
    roots = m.filter("parent_id IS NULL").select(F.col("message_id").alias("node"))
    below = descendants(m.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("parent"), F.col("message_id").alias("child")), roots)
    below = below.select("root", "node").unionByName(roots.select(F.col("node").alias("root"), "node"))
    last = below.join(m.select(F.col("message_id").alias("node"), "date"), "node").groupBy("root").agg(F.max("date").alias("last"))
    heads = m.join(last, m["message_id"] == last["root"]).select("corpus", subject_key(F.col("subject")).alias("key"), F.col("message_id").alias("id"), "subject", "date", "last")
    owner = written(subject_clusters(heads.filter("key <> ''")), "thread-owners")
    named = heads.select(F.col("id").alias("root"), "key").join(owner.withColumnRenamed("id", "root"), "root", "left")
    rows = m.join(below.join(named, "root"), m["message_id"] == below["node"], "left").drop("node")
    rows = rows.withColumn("parent_id", F.coalesce("parent_id", F.when(F.col("thread") != F.col("root"), F.col("thread"))))
    inside = placed(rows.filter("thread IS NOT NULL"), ["thread"], [F.col("date").asc_nulls_last(), F.col("message_id").asc()])
    return inside.unionByName(rows.filter("thread IS NULL").withColumn("place", F.lit(None).cast(dict(inside.dtypes)["place"])))


def subject_key(subject: Column) -> Column:
    return F.lower(X.subject(F.coalesce(subject, F.lit(""))))


def assembled(messages: DataFrame) -> DataFrame:
    """Conversations: message_id, parent_id, thread (the id of its first root) and place (by date, undated last).

    messages: corpus, message_id, subject, date (timestamp or null), in_reply_to, references, path. Copies of a message
    are one. Roots of one subject are joined as `subject_clusters` says, and hang below the first. Roots without a subject,
    and messages that only reply to one another, belong to no conversation.
    """
    return forest(messages).filter("thread IS NOT NULL").select("message_id", "parent_id", "thread", "corpus", "subject", "date", "place")


def slugs(threads: DataFrame) -> DataFrame:
    """A name for each thread of its first day and subject; equal names are numbered from the second on. threads: thread, subject, first (date or null)."""
    bare = F.coalesce(F.when(X.subject(F.col("subject")) != "", X.subject(F.col("subject"))), F.lit("no-subject"))
    day = F.coalesce(F.date_format("first", "yyyy-MM-dd"), F.lit("undated"))
    rows = threads.withColumn("slug", F.concat_ws("-", day, F.when(X.slug(bare) != "", X.slug(bare))))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("first", "thread"))
    return rows.withColumn("_n", n).withColumn("slug", F.when(F.col("_n") > 1, F.concat_ws("-", "slug", "_n")).otherwise(F.col("slug"))).drop("_n")


def tagged_participants(messages: DataFrame, people: DataFrame) -> DataFrame:
    """Senders of each thread by number of messages, then name, with role and affiliation. people: sender, role, affiliation (one row a sender)."""
    return participants(messages).join(people, "sender", "left").select("thread", "rank", "sender", "n", "role", "affiliation")


#: Longest name that counts as a citation, and what is shown around one.
NAME_MOST, SHOWN_BEFORE, SHOWN_AFTER = 60, 40, 80


def cited_sections(files: DataFrame) -> DataFrame:
    """Draft, file, chunk_idx: which message of a file names which draft, each once. files: file, text.

    Texts are split at message headers first, so a name's place is the section it was found in: the last header at or
    before it, with 0 for what stands before the first.
    """
    from skein.operators.chunking import message_chunks

    parts = message_chunks(files.select("file", "text"))
    own = F.regexp_replace("part", r"(?m)^\s*>.*$", "")
    names = parts.select("file", "chunk_idx", F.explode(F.regexp_extract_all(F.lower(own), F.lit(X.DRAFT_NAME), F.lit(0))).alias("raw"))
    return names.filter(F.length("raw") <= NAME_MOST).select(X.draft_name(F.col("raw")).alias("draft"), "file", "chunk_idx").distinct()


def citation_totals(cited: DataFrame) -> DataFrame:
    """Places and files of each draft, and the first of them."""
    return cited.groupBy("draft").agg(F.count("*").alias("places"), F.count_distinct("file").alias("files"), F.min(F.struct("file", "chunk_idx")).alias("_f")).select("draft", "places", "files", F.col("_f.file").alias("file"), F.col("_f.chunk_idx").alias("chunk_idx"))
