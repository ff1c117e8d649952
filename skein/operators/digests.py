"""Derived tables, timelines, groups and meetings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import domain_within

from .ranks import placed

#: Window of activity, least messages and rows of the most active threads.
ACTIVE_DAYS, ACTIVE_LEAST, ACTIVE_ROWS = 31, 2, 5
GROUNDING_MESSAGES, GROUNDING_PEOPLE = 20, 8
#: Kinds of events that follow from a procedure and are folded to counts.
MECHANICAL = ("draft", "issue opened", "issue closed")


def ordered_issues(issues: DataFrame) -> DataFrame:
    """Open ones first, then the newest update; place from 1."""
    order = [F.desc(F.col("state") == "open"), F.desc("updated"), F.asc("number")]
    return placed(issues, ["repo"], order)


def sectioned(df: DataFrame, section: str, order: list[Column], limit: int) -> DataFrame:
    """D3: the limit holds for each section of a table."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(section).orderBy(*order))).filter(F.col("place") <= limit)


def matching(
    df: DataFrame, state: str | None = None, label: str | None = None, since=None, until=None, least: int | None = None, author: str | None = None, subject: str | None = None, role: str | None = None,
    org: str | None = None, domain: str | None = None,
) -> DataFrame:
    """Rows of a table that meet all conditions; one without a value on a conditioned column goes.

    `closed` of pull requests holds merged ones too; label, author, subject and role are parts of a text in any case of
    letters; an organisation is sought in the leading one of `orgs` only, a domain in all `domains`, with those below it.
    """
    if state:
        df = df.filter(F.lower("state").isin("closed", "merged") if state.lower() == "closed" else F.lower("state") == state.lower())
    for column, part in (("label", label), ("author", author), ("subject", subject), ("roles", role)):
        if part:
            text = F.array_join(column, ",") if dict(df.dtypes)[column].startswith("array") else F.col(column)
            df = df.filter(F.contains(F.lower(text), F.lit(part.lower())))
    if org:
        df = df.filter(F.contains(F.lower(F.try_element_at("orgs", F.lit(1))), F.lit(org.lower())))
    if domain:
        df = df.filter(F.exists("domains", lambda d: domain_within(d, domain.lower().lstrip("@."))))
    if since is not None:
        df = df.filter(F.col("last") >= since)
    if until is not None:
        df = df.filter(F.col("last") <= until)
    return df.filter(F.col("msgs") >= least) if least else df


def issue_table(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Repo, place (open ones first, then the newest update), number, state, title, labels, comments, updated, author,
    participants (all others, in the order of their first word) and duplicate_of (what the text or a comment says first).

    issues: repo, number, state, title, labels (array), created, updated (null: created), author, body; comments: repo, number, at,
    author, body. A comment without an issue goes.
    """
    own = F.array_sort(F.collect_list(F.struct("at", "author", "body")))
    said = comments.groupBy("repo", "number").agg(F.count("*").alias("comments"), own.alias("_c"))
    # places need the issues only: ranking makes several passes, none of which should gather the comments again
    order = [F.desc(F.lower("state") == "open"), F.desc_nulls_last("updated"), F.asc("number")]
    rows = placed(issues.withColumn("updated", F.coalesce("updated", "created")), ["repo"], order).join(said, ["repo", "number"], "left")
    none = F.array().cast("array<string>")
    texts = F.concat(F.array("body"), F.coalesce(F.transform("_c", lambda c: c["body"]), none))
    people = first_seen(F.col("author"), F.coalesce(F.transform("_c", lambda c: c["author"]), none))
    rows = rows.withColumn("participants", F.filter(people, lambda p: p.isNotNull() & ~p.eqNullSafe(F.col("author")))).withColumn("duplicate_of", duplicate_of(texts, F.col("number")))
    cols = ["repo", "number", "state", "title", F.array_join("labels", ", ").alias("labels"), F.coalesce("comments", F.lit(0)).alias("comments"), "updated", "author", "participants", "duplicate_of", "place"]
    return rows.select(*cols)


def pull_totals(pulls: DataFrame) -> DataFrame:
    """Outcomes, with what has no known state in a bucket of its own."""
    s = F.col("state")
    return pulls.agg(F.count_if(s == "open").alias("open"), F.count_if(s == "merged").alias("merged"), F.count_if(s == "closed").alias("closed"), F.count_if(~F.coalesce(s.isin("open", "merged", "closed"), F.lit(False))).alias("unknown"))


def labels(issues: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Labels by frequency, with descriptions if there are any."""
    n = issues.groupBy("label").agg(F.count("*").alias("n"))
    return n.join(descriptions, "label", "left") if descriptions is not None else n


def subject_tags(subjects: DataFrame) -> DataFrame:
    """Leading bracketed tags of subjects by frequency."""
    lead = F.regexp_extract("subject", r"^((?:\s*\[[^\]]*\])+)", 1)
    tags = subjects.select(F.explode(F.regexp_extract_all(lead, F.lit(r"\[([^\]]*)\]"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def timeline(parts: list[DataFrame]) -> DataFrame:
    """Events of all feeds. Each: when, kind, title."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def timeline_rows(events: DataFrame, kinds: tuple[str, ...] | None = None, exclude: tuple[str, ...] = (), since=None, until=None, limit: int = 100) -> DataFrame:
    """One limit over all years, newest first."""
    if kinds:
        events = events.filter(F.col("kind").isin(*kinds))
    if exclude:
        events = events.filter(~F.col("kind").isin(*exclude))
    if since is not None:
        events = events.filter(F.col("when") >= since)
    if until is not None:
        events = events.filter(F.col("when") <= until)
    return events.orderBy(F.desc("when"), "kind", "title").limit(limit)


def active_threads(threads: DataFrame) -> DataFrame:
    """Busiest threads of the last days before the newest activity in the data."""
    floor = threads.agg(F.date_sub(F.max("last").cast("date"), ACTIVE_DAYS).alias("_floor"))
    rows = threads.crossJoin(F.broadcast(floor)).filter((F.col("last").cast("date") >= F.col("_floor")) & (F.col("msgs") >= ACTIVE_LEAST)).drop("_floor")
    return rows.orderBy(F.desc("msgs"), F.desc("last"), "thread").limit(ACTIVE_ROWS)


def folded(events: DataFrame, rows: int) -> DataFrame:
    """Among the newest rows, mechanical kinds as counts and the others as they are."""
    newest = events.orderBy(F.desc("when"), "kind", "title").limit(rows)
    mechanical = F.col("kind").isin(*MECHANICAL)
    return newest.groupBy("kind", F.when(~mechanical, F.col("title")).alias("title")).agg(F.count("*").alias("n"), F.max("when").alias("last"))


def grounding(threads: DataFrame) -> DataFrame:
    """The largest thread that is long or wide enough."""
    wide = (F.col("msgs") >= GROUNDING_MESSAGES) | (F.col("participants") >= GROUNDING_PEOPLE)
    return threads.filter(wide).orderBy(F.desc("msgs"), F.desc("participants"), "thread").limit(1)


#: Verdicts of reviews by weight; others don't count, and none at all is a comment.
VERDICTS = ("CHANGES_REQUESTED", "APPROVED", "DISMISSED", "COMMENTED")


def verdicts(reviews: DataFrame, order: tuple[str, ...] = VERDICTS) -> DataFrame:
    """Each reviewer once, under the strongest verdict; unknown verdicts are skipped. reviews: pull, reviewer, verdict (null: the last of `order`)."""
    known = reviews.withColumn("verdict", F.upper(F.coalesce(F.when(F.col("verdict") != "", F.col("verdict")), F.lit(order[-1])))).filter(F.col("verdict").isin(*order))
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("verdict"))
    best = known.groupBy("pull", "reviewer").agg(F.min_by("verdict", rank).alias("verdict"))
    return best.groupBy("pull", "verdict").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("reviewer")), ", ").alias("reviewers"))


#: A word that closes, and an issue: an address, a repository with a number, or a number alone.
CLOSING = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*:?\s+"
CLOSED = r"(?:(?:https?://)?(?:www\.)?github\.com/([^/\s]+/[^/\s]+)/(?:issues|pulls?)/([0-9]+)|([\w.-]+/[\w.-]+)#([0-9]+)|#([0-9]+))\b"


def closes(title: Column, body: Column, own: Column, repo: Column) -> Column:
    """Numbers of issues that a pull request closes, in its title, then in its body, in order, once, without its own.

    A reference to a repository counts only if that is `repo` (owner/name, in any case); null repo: such ones never do.
    """
    text = F.concat_ws("\n", title, body)
    found = F.regexp_extract_all(text, F.lit(CLOSING + CLOSED), F.lit(0))
    part = lambda x, g: F.regexp_extract(x, CLOSING + CLOSED, g)

    def number(x: Column) -> Column:
        named = F.concat(part(x, 1), part(x, 3))
        here = (named == "") | F.coalesce(F.lower(named) == F.lower(repo), F.lit(False))
        return F.when(here, F.concat(part(x, 2), part(x, 4), part(x, 5)).cast("long"))

    return F.array_remove(F.array_distinct(F.filter(F.transform(found, number), lambda n: n.isNotNull())), own)


def milestone_status(today: Column) -> Column:
    """M6."""
    state, due = F.col("state"), F.col("due")
    return F.when(state == "dropped", "dropped").when(F.col("resolved").isNotNull(), "resolved").when(state == "review", "needs review").when(state == "proposed", "proposed").when(due < today, "overdue").otherwise("open")


def history_events(history: DataFrame) -> DataFrame:
    """M3: what changed between versions. history: milestone, time, state, due, resolved."""
    along = Window.partitionBy("milestone").orderBy("time")
    before = F.lag(F.struct("state", "due", "resolved")).over(along)
    rows = history.withColumn("_b", before)
    b = F.col("_b")
    kind = F.when(b.isNull(), "added").when((F.col("state") == "dropped") & (b["state"] != "dropped"), "dropped").when(F.col("resolved").isNotNull() & b["resolved"].isNull(), "resolved").when(~F.col("due").eqNullSafe(b["due"]), "moved")
    return rows.withColumn("event", kind).drop("_b").filter("event IS NOT NULL")


def date_clusters(rows: DataFrame, keys: list[str], day: str = "day", gap: int = 1) -> DataFrame:
    """Runs of dates at most `gap` days apart: start, end, days."""
    along = Window.partitionBy(*keys).orderBy(day)
    days = rows.select(*keys, day).distinct()
    new = F.when(F.datediff(F.col(day), F.lag(day).over(along)) <= gap, 0).otherwise(1)
    runs = days.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    return runs.groupBy(*keys, "_run").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("days")).drop("_run")


def within(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Interval that holds each date (null without). points: keys, day; intervals: keys, start, end."""
    i = intervals.select(*(F.col(k).alias(f"_{k}") for k in keys), "start", "end")
    same = F.col("day").between(F.col("start"), F.col("end"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return points.join(i, same, "left").drop(*(f"_{k}" for k in keys))


def ballot_positions(events: DataFrame) -> DataFrame:
    """Of the newest ballot the newest event of each balloter; `norecord` is none. events: doc, ballot, balloter, pos, time."""
    rows = events.filter("pos <> 'norecord'")
    newest = rows.groupBy("doc").agg(F.max_by("ballot", F.struct("time", "ballot")).alias("ballot"))
    n = F.row_number().over(Window.partitionBy("doc", "balloter").orderBy(F.desc("time"), F.desc("pos")))
    return rows.join(newest, ["doc", "ballot"]).withColumn("_n", n).filter("_n = 1").select(*events.columns)


def merged_feed(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """M5: incoming rows replace stored ones of the same key."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def refreshed_feed(stored: DataFrame, watermark, incoming: DataFrame | None, key: str = "id", time: str = "time") -> tuple[DataFrame, DataFrame]:
    """M5: the merged feed and its next watermark (the newest time, to the second), to be stored together; a failed fetch (None) changes neither."""
    if incoming is None:
        return stored, stored.sparkSession.range(1).select(F.lit(watermark).alias("watermark"))
    newest = F.max(F.date_trunc("second", F.col(time).cast("timestamp")))
    return merged_feed(stored, incoming, key), incoming.agg(F.greatest(newest, F.lit(watermark).cast("timestamp")).alias("watermark"))


def agenda_eligibility() -> Column:
    """What a document is for an agenda, in strict precedence. Columns: state, iesg, stream (texts or null), number (null unless published), lapsed (its expiry is past)."""
    low = lambda c: F.coalesce(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))
    state, iesg, stream = low("state"), low("iesg"), low("stream")
    published = F.col("number").isNotNull() | (state == "rfc")
    dead = state.isin("expired", "replaced", "repl") | (iesg == "dead") | (stream == "dead")
    out = F.when(published, "published").when(dead, "dead").when(((iesg != "") & (iesg != "i-d exists")) | (stream == "sub-pub"), "in-iesg")
    return out.when(F.coalesce("lapsed", F.lit(False)), "dead").when((iesg == "i-d exists") | (state == "active"), "in-wg").otherwise("unknown")


def reconciled_drafts(live: DataFrame, cached: DataFrame) -> DataFrame:
    """Live and cached names: `advanced` (both, no longer active) and `revived` (live only)."""
    both = live.join(cached.select(F.col("name"), F.col("eligibility").alias("_was")), "name", "left")
    kind = F.when(F.col("_was").isNull(), "revived").when(F.col("_was") != "active", "advanced")
    return both.withColumn("change", kind).filter("change IS NOT NULL").select("name", "change").distinct()


def group_records(groups: DataFrame, areas: DataFrame, charters: DataFrame) -> DataFrame:
    """M1: two left joins on addresses."""
    a = areas.select(F.col("uri").alias("parent"), F.col("name").alias("area"))
    c = charters.groupBy(F.col("group").alias("uri")).agg(F.max("rev").alias("rev"))
    return groups.join(a, "parent", "left").join(c, "uri", "left")


def artefacts(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Artefacts of each meeting by kind. rows: meeting, kind."""
    return rows.groupBy("meeting").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def stale_miss(absent: Column, age_hours: Column) -> Column:
    """Only a record that is absent from a mirror older than a day is looked up again."""
    return absent & (age_hours > 24)


def duplicate_of(texts: Column, own: Column) -> Column:
    """First issue that one of the texts, in order, calls its original."""
    found = F.transform(texts, lambda t: F.expr("0L") + F.coalesce(F.regexp_extract(F.lower(t), r"(?:duplicate|dup)\s+of\s+#([0-9]+)", 1).try_cast("long"), F.lit(0)))
    return F.try_element_at(F.filter(found, lambda n: (n > 0) & (n != own)), F.lit(1))


def closing_rationale(state: Column, comments: Column) -> Column:
    """The last comment of what is closed."""
    return F.when(F.lower(state) == "closed", F.try_element_at(comments, F.lit(-1)))


def first_seen(author: Column, commenters: Column) -> Column:
    """Participants in the order of their first word."""
    return F.array_distinct(F.concat(F.array(author), commenters))


# Subjects that announce a revision, a call for adoption, a last call; names of meetings.
ANNOUNCED = r"(?i)^I-D Action:\s*(draft-[A-Za-z0-9._-]+?)-([0-9]+)\.txt$"
ADOPTION, LAST_CALL = r"(?i)call\s+for\s+adoption", r"(?i)WG\s*Last\s*Call|Working\s*Group\s*Last\s*Call|WGLC"


def publications(threads: DataFrame) -> DataFrame:
    """An event for each announced revision. threads: thread, subject (without list tags), first."""
    subject = F.regexp_replace("subject", r"^\s+|\s+$", "")
    name, rev = F.regexp_extract(subject, ANNOUNCED, 1), F.regexp_extract(subject, ANNOUNCED, 2)
    return threads.filter((name != "") & F.col("first").isNotNull()).select(F.col("first").alias("when"), F.lit("draft-published").alias("kind"), F.concat(F.lit("`"), name, F.lit("-"), rev, F.lit("` published")).alias("title"), F.lit(None).cast("string").alias("detail"), "thread")


def procedural(threads: DataFrame) -> DataFrame:
    """Threads that begin a call for adoption, else a last call. threads: thread, subject, first, msgs, participants."""
    subject = F.regexp_replace("subject", r"^\s+|\s+$", "")
    kind = F.when(subject.rlike(ADOPTION), "adoption-call").when(subject.rlike(LAST_CALL), "wglc")
    lead = F.when(kind == "adoption-call", 'Call for adoption thread starts: "').otherwise('WG Last Call thread: "')
    detail = F.concat(F.col("msgs").cast("string"), F.lit(" messages, "), F.col("participants").cast("string"), F.lit(" participants"))
    return threads.filter(kind.isNotNull() & F.col("first").isNotNull()).select(F.col("first").alias("when"), kind.alias("kind"), F.concat(lead, subject, F.lit('"')).alias("title"), detail.alias("detail"), "thread")


def meeting_label(code: Column) -> Column:
    """`ietf124` or `interim2025abc09` as a short name; other codes as they are."""
    number, year, n = F.regexp_extract(code, r"(?i)^ietf([0-9]+)$", 1), F.regexp_extract(code, r"(?i)^interim([0-9]{4})\w*?([0-9]+)$", 1), F.regexp_extract(code, r"(?i)^interim([0-9]{4})\w*?([0-9]+)$", 2)
    return F.when(number != "", F.concat(F.lit("IETF "), number, F.lit(" meeting"))).when(year != "", F.concat(F.lit("Interim "), year, F.lit(" #"), n)).otherwise(code)


def sessions(minutes: DataFrame, slides: DataFrame, transcripts: DataFrame) -> DataFrame:
    """An event for each session: minutes date it, slides of dated sessions are counted, transcripts join by code.

    minutes: code, date (null: undated, no session); slides: code; transcripts: path, code (or null), when, label (or
    null). Transcripts without a dated session make one of their own for each time; slides alone make none.
    """
    dated = minutes.filter("date IS NOT NULL").groupBy("code").agg(F.min("date").alias("date"))
    decks = slides.groupBy("code").agg(F.count("*").alias("slides"))
    spoken = transcripts.filter("when IS NOT NULL")
    joined = spoken.join(dated, "code", "left_semi").groupBy("code").agg(F.sort_array(F.collect_list("path")).alias("transcripts"))
    known = dated.join(decks, "code", "left").join(joined, "code", "left").select(F.col("date").cast("timestamp").alias("when"), meeting_label(F.col("code")).alias("title"), "code", F.coalesce("slides", F.lit(0)).alias("slides"), "transcripts")
    alone = spoken.join(dated, "code", "left_anti").groupBy("when").agg(F.min_by("label", "path").alias("label"), F.sort_array(F.collect_list("path")).alias("transcripts"))
    own = F.coalesce("label", F.concat(F.lit("session ("), F.date_format("when", "yyyy-MM-dd HH:mm"), F.lit(" UTC)")))
    orphans = alone.select("when", own.alias("title"), F.lit(None).cast("string").alias("code"), F.lit(0).cast("long").alias("slides"), "transcripts")
    return known.withColumn("slides", F.col("slides").cast("long")).unionByName(orphans).withColumn("kind", F.lit("meeting"))


def issue_events(issues: DataFrame) -> DataFrame:
    """Opened and closed events of issues (not of pull requests). issues: repo, number, title, author, state, created, closed, updated."""
    number, title = F.col("number").cast("string"), F.regexp_replace("title", r"^\s+|\s+$", "")
    said = lambda what: F.concat(F.lit("Issue #"), number, F.lit(f' {what}: "'), title, F.lit('"'))
    opened = issues.filter("created IS NOT NULL").select(F.col("created").alias("when"), F.lit("issue-opened").alias("kind"), said("opened").alias("title"), F.concat(F.lit("by "), "author", F.lit(" ("), "repo", F.lit(")")).alias("detail"))
    end = F.coalesce("closed", "updated")
    closed = issues.filter((F.lower("state") == "closed") & end.isNotNull()).select(end.alias("when"), F.lit("issue-closed").alias("kind"), said("closed").alias("title"), F.concat(F.lit("("), "repo", F.lit(")")).alias("detail"))
    return opened.unionByName(closed)


def event_table(parts: list[DataFrame]) -> DataFrame:
    """All events as one table (when, kind, title, detail), to be written by year and kind."""
    cols = ["when", "kind", "title", "detail"]
    full = [p.select(*(F.col(c) if c in p.columns else F.lit(None).cast("string").alias(c) for c in cols)) for p in parts]
    return timeline(full)


def people_note(people: DataFrame, matching_rows: Column, limit: int) -> DataFrame:
    """Total, matched, shown, and people without organisation or domain, over the unfiltered table. people: org, domain."""
    matched = F.count_if(matching_rows)
    return people.agg(F.count("*").alias("total"), matched.alias("matched"), F.least(matched, F.lit(limit)).alias("shown"), F.count_if(F.col("org").isNull()).alias("no_org"), F.count_if(F.col("domain").isNull()).alias("no_domain"))


def recent_open(issues: DataFrame, limit: int) -> DataFrame:
    """The newest open issues: repo, number, title, updated."""
    return issues.filter("state = 'open'").orderBy(F.desc("updated"), "repo", "number").limit(limit).select("repo", "number", "title", "updated")


def ballot_events(positions: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """An event for each position, from `cutoff` on. positions: doc, balloter, pos, time, rev."""
    rows = positions.filter(F.col("time") >= cutoff) if cutoff is not None else positions
    title = F.concat("balloter", F.lit(": "), "pos", F.when(F.coalesce("rev", F.lit("")) != "", F.concat(F.lit(" on -"), "rev")).otherwise(""))
    return rows.select(F.col("time").alias("when"), F.lit("ballot").alias("kind"), title.alias("title"), F.col("doc").alias("detail"))


def meeting_times(sessions_: DataFrame) -> DataFrame:
    """Start and end in UTC, and length in minutes, of sessions given in the local time of their venue. sessions: code, local (text `yyyy-MM-dd HH:mm`), zone, duration (`h:mm` or `hh:mm:ss`)."""
    hours, minutes = F.regexp_extract("duration", r"^(\d+):(\d{2})", 1).cast("int"), F.regexp_extract("duration", r"^(\d+):(\d{2})", 2).cast("int")
    rows = sessions_.withColumn("minutes", hours * 60 + minutes).withColumn("start", F.to_utc_timestamp(F.try_to_timestamp("local", F.lit("yyyy-MM-dd HH:mm")), F.coalesce("zone", F.lit("UTC"))))
    return rows.withColumn("end", F.timestamp_seconds(F.unix_timestamp("start") + F.col("minutes") * 60))


def ceilings(issues: DataFrame) -> DataFrame:
    """The greatest number and the number of issues of each repository."""
    return issues.groupBy("repo").agg(F.max("number").alias("ceiling"), F.count("*").alias("n"))


def overlapping(tokens: DataFrame, corpus: Column, most: int = 1) -> DataFrame:
    """The corpora that share most tokens with one. tokens: corpus, token."""
    each = tokens.distinct()
    own = each.filter(F.col("corpus") == corpus).select("token")
    return each.filter(F.col("corpus") != corpus).join(own, "token", "left_semi").groupBy("corpus").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "corpus").limit(most)


def histogram(rows: DataFrame, column: str, width: float, most: int) -> DataFrame:
    """Counts by buckets of equal width from 1 on; 0 holds what is below 0 and `most` all that is above."""
    bucket = F.least(F.lit(most), F.greatest(F.lit(0), F.floor(F.col(column) / width) + 1)).cast("int")
    return rows.filter(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


#: Bounds in seconds of a call, and of a gathering.
CALL_BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)
GATHER_BOUNDS = (5.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1200.0, 1800.0, 3600.0)


def call_metrics(calls: DataFrame, keys: tuple[str, ...] = ("name",), bounds: tuple[float, ...] = CALL_BOUNDS) -> DataFrame:
    """For each key the number of calls, errors (timeouts among them), timeouts, seconds, and `within`: calls of at most each bound.

    calls: keys, seconds, error, timeout (null: false). A call without a time counts, but within no bound.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    within = F.array(*[F.count_if(F.col("seconds") <= b) for b in bounds])
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(yes("error") | yes("timeout")).alias("errors"), F.count_if(yes("timeout")).alias("timeouts"), F.sum("seconds").alias("seconds"), within.alias("within"))


def thread_sizes(threads: DataFrame, wanted: DataFrame) -> DataFrame:
    """Messages of the threads asked for; null for unknown ones. threads: thread, msgs; wanted: thread."""
    return wanted.select("thread").distinct().join(threads.select("thread", "msgs"), "thread", "left")


def first_rows(events: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The newest rows of a timeline, and the kinds that occur in all of it."""
    return events.orderBy(F.desc("when"), "kind", "title").limit(limit), events.select("kind").distinct()
