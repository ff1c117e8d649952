"""Chunking, hashing and incremental builds (C1 to C35). Offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the chunker: window, overlap, length of a title taken from text, cap of a legacy record.
WINDOW, OVERLAP, TITLE_CHARS, LEGACY_CHARS = 1200, 150, 80, 8000
SPACES = r"^\s+|\s+$"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends (SQL trim knows spaces only)."""
    return F.regexp_replace(text, SPACES, "")


def window_count(length: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    step = window - overlap
    more = F.ceil((length - window) / step).cast("int") + 1
    return F.when(length == 0, 0).when(length <= window, 1).otherwise(more)


def windows(df: DataFrame, text: str = "text", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """sub_idx, offset and window of each text; the last window is the first that reaches the end. Empty: no rows."""
    n = window_count(F.length(text), window, overlap)
    rows = df.withColumn("_n", n).filter("_n > 0").withColumn("sub_idx", F.explode(F.expr("sequence(0, _n - 1)")))
    at = F.col("sub_idx") * (window - overlap)
    return rows.withColumn("offset", at).withColumn("window", F.substring(F.col(text), at + 1, F.lit(window))).drop("_n")


def line_of(text: Column, offset: Column) -> Column:
    """Number of the line that holds an offset; lines end with a line feed only."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def windowed_chunks(df: DataFrame) -> DataFrame:
    """Text without white space around it, in windows with the lines they start on, titled by its first line."""
    head = F.length("text") - F.length(F.regexp_replace("text", r"^\s+", ""))
    rows = df.withColumn("_body", stripped(F.col("text"))).withColumn("_head", head)
    rows = windows(rows, "_body")
    first = F.regexp_extract("_body", r"^([^\n]*)", 1)
    return rows.withColumn("title", F.substring(first, 1, TITLE_CHARS)).withColumn("start_line", line_of(F.col("text"), F.col("_head") + F.col("offset"))).drop("_body", "_head")


MESSAGE_HEADER = r"(?m)(?=^### \[\d+\] )"


def message_chunks(df: DataFrame) -> DataFrame:
    """C4: a chunk for each message header `### [N] date — sender`; what stands before the first is chunk 0."""
    parts = df.withColumn("part", F.explode(F.split("text", MESSAGE_HEADER)))
    number = F.regexp_extract("part", r"^### \[(\d+)\]", 1)
    parts = parts.filter(stripped(F.col("part")) != "")
    return parts.withColumn("chunk_idx", F.when(number == "", 0).otherwise(F.expr("try_cast(regexp_extract(part, '^### \\\\[([0-9]+)\\\\]', 1) AS INT)")))


def record_chunks(df: DataFrame) -> DataFrame:
    """Records between lines of equals signs, each cut at the legacy cap."""
    parts = df.select("*", F.posexplode(F.split("text", r"\n=+\n+")).alias("chunk_idx", "part"))
    return parts.filter(stripped(F.col("part")) != "").withColumn("part", F.substring(stripped(F.col("part")), 1, LEGACY_CHARS))


def iso_date(text: Column) -> Column:
    """ISO text in UTC of a date without zone (taken as UTC), with or without seconds, or in the mail format."""
    trimmed = stripped(text)
    when = F.coalesce(F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(F.regexp_replace(trimmed, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")


SKIPPED_KINDS = ("digests", "github", "raw", "pulls", "state")
CONCLUDED = ("rfc", "repl")


def eligible(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """C11: text files worth indexing. files: relpath; manifest: draft, state."""
    kind = F.element_at(F.split("relpath", "/"), 1)
    keep = files.filter(~kind.isin(*SKIPPED_KINDS) & F.lower("relpath").rlike(r"\.(txt|md)$"))
    stem = F.regexp_extract("relpath", r"^drafts/(draft-.*?)(?:-\d{2})?\.(?:txt|md)$", 1)
    gone = manifest.filter(F.col("state").isin(*CONCLUDED)).select(F.col("draft").alias("_stem")).distinct()
    return keep.withColumn("_stem", stem).join(gone, "_stem", "left_anti").drop("_stem")


def build_plan(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Relpath, action: `new`, `changed`, `unchanged` or `orphan`. Both: relpath, sha256."""
    both = new.select("relpath", F.col("sha256").alias("_new")).join(stored.select("relpath", F.col("sha256").alias("_old")), "relpath", "full_outer")
    action = F.when(F.col("_old").isNull() & F.col("_new").isNotNull(), "new").when(F.col("_new").isNull(), "orphan").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("changed")
    return both.select("relpath", action.alias("action"))


def reused(chunks: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("file", "chunk_hash")) -> DataFrame:
    """Stored vectors of chunks whose embedded text is the same; null where it must be embedded."""
    one = stored.groupBy(*keys).agg(F.min_by("embedding", "chunk_idx").alias("embedding"))
    return chunks.join(one, list(keys), "left")


def stamped(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """A file keeps its hash only if none of its chunks lacks a vector, so that a failed one is tried again."""
    whole = chunks.groupBy("file").agg(F.bool_and(F.col("embedding").isNotNull()).alias("_whole"))
    done = F.coalesce(F.col("_whole"), F.lit(True))
    return files.join(whole, files["relpath"] == whole["file"], "left").select("relpath", F.when(done, F.col("sha256")).alias("sha256"))


def trimmed_overlaps(parts: DataFrame) -> DataFrame:
    """The part of each byte range that no earlier range of its section covers. parts: doc, section, off, len."""
    before = Window.partitionBy("doc", "section").orderBy("off", "len").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.col("off") + F.col("len")).over(before), F.lit(0))
    start = F.greatest(F.col("off"), covered)
    return parts.withColumn("start", start).withColumn("kept", F.greatest(F.lit(0), F.col("off") + F.col("len") - start))


def section_spans(parts: DataFrame) -> DataFrame:
    """Range of each (doc, section); parts without a section stay single."""
    named = parts.filter("section IS NOT NULL").groupBy("doc", "section").agg(F.min("off").alias("low"), F.max(F.col("off") + F.col("len")).alias("high"))
    return named.unionByName(parts.filter("section IS NULL").select("doc", "section", F.col("off").alias("low"), (F.col("off") + F.col("len")).alias("high")))


def reconciled(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Matched, differing, absent; driven by the expected digests. Both: doc, digest."""
    both = expected.join(actual.select("doc", F.col("digest").alias("_got")), "doc", "left")
    got, want = F.col("_got"), F.col("digest")
    return both.agg(F.count_if(got == want).alias("matched"), F.count_if(got != want).alias("differing"), F.count_if(got.isNull()).alias("absent"))


def feeds(text: Column) -> Column:
    """Line feeds in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def section_chunks(sections: DataFrame) -> DataFrame:
    """Fragments of each section that share its chunk_idx. sections: file, chunk_idx, title, body, start_line.

    Adds sub_idx, text, embed_text, start_line, end_line. Fragment 0 has the whole text and all its lines, and embeds
    the first window only; others have their window and its lines. Titles of sections in several fragments say which.
    An empty section is one fragment.
    """
    parts = F.greatest(F.lit(1), window_count(F.length("body")))
    rows = sections.withColumn("_n", parts).withColumn("sub_idx", F.explode(F.expr("sequence(0, _n - 1)"))).withColumn("_low", F.col("sub_idx") * (WINDOW - OVERLAP))
    rows = rows.withColumn("embed_text", F.substring(F.col("body"), F.col("_low") + 1, F.lit(WINDOW)))
    first, end = F.col("sub_idx") == 0, F.when(F.col("sub_idx") == 0, F.length("body")).otherwise(F.col("_low") + F.length("embed_text"))
    title = F.when(F.col("_n") > 1, F.concat("title", F.lit(" (part "), F.col("sub_idx") + 1, F.lit("/"), F.col("_n"), F.lit(")"))).otherwise(F.col("title"))
    last = F.col("start_line") + feeds(F.substring(F.col("body"), F.lit(1), F.greatest(end - 1, F.lit(0))))
    start = F.col("start_line") + feeds(F.substring(F.col("body"), F.lit(1), F.col("_low")))
    rows = rows.withColumn("text", F.when(first, F.col("body")).otherwise(F.col("embed_text"))).withColumn("title", title).withColumn("end_line", last)
    return rows.withColumn("start_line", start).drop("_n", "_low", "body")


# Header lines of issue files, of charters, of legacy records.
ISSUE_LABELS, ISSUE_URL, ISSUE_STATE = r"(?m)^\*\*Labels:\*\*\s*(.+?)\s*$", r"(?m)^\*\*URL:\*\*\s*(\S+)", r"(?m)^\*\*State:\*\*\s*(\S+)"
ISSUE_DUPLICATE, ISSUE_RATIONALE = r"(?m)^\*\*Duplicate of:\*\*\s*#?([0-9]+)", r"(?ms)^\*\*Closing rationale:\*\*\s*\n+(.+?)(?:\n\n##|\z)"
CHARTER_TITLE, CHARTER_STATE, CHARTER_AREA = r"(?m)^# (.+)$", r"(?m)^State:\s*(\S+)", r"(?m)^Area:.*\((\S+)\)\s*$"
CHARTER_KIND, CHARTER_SOURCE, RECORD_ISSUE, RECORD_DATE = r"(?m)^Type:\s*(Working|Research) Group", r"(?m)^Source:\s*(\S+)", r"(?m)^Issue #([0-9]+):\s*(.+)$", r"(?m)^Date:\s*(.+)$"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one."""
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def issue_header(text: Column) -> Column:
    """Struct of labels (lower case, joined by commas), url, duplicate_of, rationale and state; null where a line is missing."""
    each = F.filter(F.transform(F.split(_found(text, ISSUE_LABELS), ","), lambda x: F.lower(stripped(x))), lambda x: x != "")
    labels = F.when(F.size(each) > 0, F.array_join(each, ","))
    return F.struct(
        labels.alias("labels"), _found(text, ISSUE_URL).alias("url"), _found(text, ISSUE_DUPLICATE).cast("long").alias("duplicate_of"),
        stripped(_found(text, ISSUE_RATIONALE)).alias("rationale"), F.lower(_found(text, ISSUE_STATE)).alias("state"),
    )


def chunker_of(relpath: Column) -> Column:
    """Which chunker a file goes to."""
    low = F.lower(relpath)
    kind = F.when(low.startswith("threads/"), "thread").when(low.startswith("issues/"), "thread").when(low.startswith("charters/"), "charter")
    return F.coalesce(F.when(low.endswith(".md"), kind), F.lit("window"))


def citation_url(relpath: Column, text: Column, base: str) -> Column:
    """C14: the page of a draft below `base`, the source line of a charter; null for all other files, whose address isn't sure."""
    from skein.functions.text import draft_name

    low, name = F.lower(relpath), draft_name(F.element_at(F.split(relpath, "/"), -1))
    draft = F.when(name.startswith("draft-"), F.concat(F.lit(base.rstrip("/") + "/"), name, F.lit("/")))
    charter = (low == "charter.txt") | low.endswith("/charter.txt")
    return F.when(low.startswith("drafts/") & low.endswith(".txt"), draft).when(charter, _found(text, CHARTER_SOURCE))


def charter_chunks(df: DataFrame) -> DataFrame:
    """Windows of charters, each with the group's title, state, labels (area, type) and source. df: file, text."""
    area, kind = F.concat(F.lit("area:"), F.lower(_found(F.col("text"), CHARTER_AREA))), F.when(_found(F.col("text"), CHARTER_KIND) == "Working", "type:wg").when(_found(F.col("text"), CHARTER_KIND) == "Research", "type:rg")
    labels = F.concat_ws(",", area, kind)
    rows = windowed_chunks(df)
    rows = rows.withColumn("title", F.coalesce(F.substring(_found(F.col("text"), CHARTER_TITLE), 1, TITLE_CHARS), F.col("title")))
    return rows.withColumn("state", F.lower(_found(F.col("text"), CHARTER_STATE))).withColumn("labels", F.when(labels != "", labels)).withColumn("url", _found(F.col("text"), CHARTER_SOURCE))


def issue_records(df: DataFrame) -> DataFrame:
    """Records of a legacy dump as chunks titled by their issue, with its date."""
    rows = record_chunks(df)
    number = _found(F.col("part"), RECORD_ISSUE)
    title = F.when(number.isNotNull(), F.concat(F.lit("#"), number, F.lit(": "), stripped(_found(F.col("part"), RECORD_ISSUE, 2)))).otherwise(F.concat(F.lit("record "), "chunk_idx"))
    return rows.withColumn("title", title).withColumn("chunk_date", iso_date(_found(F.col("part"), RECORD_DATE)))


def embedded(chunks: DataFrame, embed, batch: int = 512) -> DataFrame:
    """`embedding` of chunks that have none, by an injected function of a list of texts, so many at a time."""
    from collections.abc import Iterator

    import pandas as pd

    fields = ", ".join(f"`{c}` {t}" for c, t in chunks.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for low in range(0, len(f), batch):
                part = f.iloc[low : low + batch].copy()
                todo = part["embedding"].isna()
                if todo.any():
                    vectors = iter(embed(part.loc[todo, "embed_text"].tolist()))
                    part["embedding"] = [next(vectors) if t else v for t, v in zip(todo, part["embedding"], strict=True)]
                yield part

    return chunks.mapInPandas(run, fields)


def rebuilt(files: DataFrame, stored_files: DataFrame, stored_chunks: DataFrame, chunker, embed) -> tuple[DataFrame, DataFrame]:
    """The chunk and file tables of the next version of an index.

    files: relpath, sha256, text; stored_files: relpath, sha256; stored_chunks: file, chunk_idx, sub_idx, embed_text,
    chunk_hash, embedding, ...; chunker: DataFrame of (file, text) to chunks without the last two. Unchanged files keep
    their chunks, orphans go, all others are chunked anew and embed only texts that no stored chunk of the file has.
    """
    plan = build_plan(files.select("relpath", "sha256"), stored_files)
    keep = plan.filter("action = 'unchanged'").select(F.col("relpath").alias("file"))
    todo = plan.filter("action IN ('new', 'changed')").select("relpath")
    fresh = chunker(files.join(todo, "relpath", "left_semi").select(F.col("relpath").alias("file"), "text")).withColumn("chunk_hash", F.sha2("embed_text", 256))
    fresh = embedded(reused(fresh, stored_chunks.select("file", "chunk_hash", "chunk_idx", "embedding")), embed)
    chunks = stored_chunks.join(keep, "file", "left_semi").unionByName(fresh.select(stored_chunks.columns))
    return chunks, stamped(files.select("relpath", "sha256"), chunks)


#: A message's header line: number, date, sender, role, annotation and parent.
MESSAGE_LINE = r"^### \[([0-9]+)\] +(\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2})?|undated) +— +(.*?)(?: +\(((?!reply to \[)[^()]*)\))?(?: +_\([^)]*\)_)?(?: +\(reply to \[([0-9]+)\]\))?\s*$"


def message_header(part: Column) -> Column:
    """Struct of number, date (ISO text in UTC or null), sender, role and parent (number or null) of a message chunk; all null without a header."""
    line = F.regexp_extract(part, r"^([^\n]*)", 1)
    group = lambda k: _found(line, MESSAGE_LINE, k)
    day = F.when(F.length(group(2)) == 10, F.concat(group(2), F.lit(" 00:00"))).otherwise(group(2))
    return F.struct(group(1).cast("int").alias("number"), iso_date(day).alias("date"), group(3).alias("sender"), group(4).alias("role"), group(5).cast("int").alias("parent"))


def thread_chunks(files: DataFrame) -> DataFrame:
    """Messages of thread and issue files with what their headers and the file's header say.

    files: file, text. Returns file, chunk_idx, title (the header line), body, start_line, chunk_date, sender, role,
    parent, url (the message's permalink, else the issue's), labels, state, duplicate_of, rationale.
    """
    head = files.withColumn("h", issue_header(F.col("text")))
    # characters before each part, from the lengths of the parts before it
    parts = head.select("*", F.split("text", MESSAGE_HEADER).alias("_all")).select("*", F.posexplode("_all").alias("_k", "part"))
    before = F.expr("aggregate(slice(_all, 1, _k), 0, (a, x) -> a + length(x) - length(replace(x, '\n', '')))")
    m = parts.withColumn("m", message_header(F.col("part"))).withColumn("start_line", before + 1).filter(stripped(F.col("part")) != "")
    permalink = _found(F.col("part"), r"(?m)^_Archived-At:_\s*(\S+)")
    title = F.regexp_replace(F.regexp_extract("part", r"^([^\n]*)", 1), "^#+ ", "")
    return m.select(
        "file", F.coalesce("m.number", F.lit(0)).alias("chunk_idx"), F.substring(title, 1, TITLE_CHARS).alias("title"), F.col("part").alias("body"), "start_line", F.col("m.date").alias("chunk_date"), "m.sender", "m.role", "m.parent",
        F.coalesce(permalink, "h.url").alias("url"), "h.labels", "h.state", "h.duplicate_of", "h.rationale",
    )


def reply_graph(files: DataFrame) -> DataFrame:
    """File, parent, child (numbers of messages) as the header lines say."""
    return thread_chunks(files).filter("parent IS NOT NULL").select("file", "parent", F.col("chunk_idx").alias("child"))


def with_hashes(chunks: DataFrame) -> DataFrame:
    """Hashes of the rows that have none yet."""
    return chunks.withColumn("chunk_hash", F.coalesce("chunk_hash", F.sha2("embed_text", 256)))


def document_vectors(chunks: DataFrame, most_chars: int = 4000) -> DataFrame:
    """File, title (that of the first chunk with one), text (the first characters, in order), last_active, embedding (the mean of its fragments, of length 1).

    chunks: file, chunk_idx, sub_idx, title, text, chunk_date, embedding. Only chunks that begin within the first
    characters are collected, found from the running length of a file's own chunks.
    """
    from skein.functions.vectors import mean_vectors, normalised

    order = [F.col("chunk_idx").isNull().alias("_last"), F.col("chunk_idx"), F.col("text")]
    until = F.sum(F.length("text") + 1).over(Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    whole = chunks.filter("sub_idx = 0").withColumn("_at", F.coalesce(until, F.lit(0)))
    # one that begins right after the cut counts: the line end before it is the last character
    lead = F.when(F.col("_at") <= most_chars, F.struct(*order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(lead)), lambda x: x["text"]), "\n")
    title = F.min_by("title", F.when(F.col("title").isNotNull(), F.col("chunk_idx")))
    facts = whole.groupBy("file").agg(title.alias("title"), F.max("chunk_date").alias("last_active"), F.substring(text, 1, most_chars).alias("text"))
    vectors = mean_vectors(chunks, ["file"]).select(F.col("file").alias("_file"), normalised(F.col("mean")).alias("embedding"))
    return facts.join(vectors, F.col("file").eqNullSafe(F.col("_file"))).drop("_file")
