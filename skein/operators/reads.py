"""Point, range and section reads, and scans for evidence of absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running

#: Fixed caps: lines and characters of a window, matches shown a file and in all, characters of a shown line, lines around a match.
WINDOW_LINES, WINDOW_CHARS, PER_FILE, IN_ALL, LINE_CHARS, CONTEXT_MOST = 5000, 40_000, 20, 200, 400, 5


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Line (from 1) and its text; a line feed at the end opens no line."""
    parts = F.split(F.col(text), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return df.select("*", F.posexplode(parts).alias("_pos", "line_text")).withColumn("line", F.col("_pos") + 1).drop("_pos")


def line_chunks(files: DataFrame, size: int) -> DataFrame:
    """file, chunk_idx, start_line, end_line: chunks of `size` lines, as many as each file's own lines need."""
    count = F.size(F.split("text", "\n", -1)) - F.when(F.col("text").endswith("\n") | (F.col("text") == ""), 1).otherwise(0)
    last = F.expr(f"(_lines - 1) div {size}")
    c = files.select("file", count.cast("long").alias("_lines")).filter("_lines > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_idx"))
    return c.withColumn("start_line", F.col("chunk_idx") * size + 1).withColumn("end_line", F.col("chunk_idx") * size + size)


def outline(chunks: DataFrame) -> DataFrame:
    """Sections with their first chunk, its title and the characters of all."""
    return chunks.groupBy("file", "section").agg(F.min_by("title", "chunk_idx").alias("title"), F.min("chunk_idx").alias("first"), F.sum(F.length("text")).alias("chars"))


def section_runs(chunks: DataFrame) -> DataFrame:
    """S3: texts of consecutive chunks of one section joined; a chunk without section is a run of its own. chunks: file, chunk_idx, section, text."""
    along = Window.partitionBy("file").orderBy("chunk_idx")
    new = F.when(F.col("section").isNull() | ~F.col("section").eqNullSafe(F.lag("section").over(along)), 1).otherwise(0)
    runs = chunks.withColumn("_new", new).withColumn("run", F.sum("_new").over(along))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x["text"]), "\n")
    return runs.groupBy("file", "run").agg(F.first("section").alias("section"), F.min("chunk_idx").alias("first"), text.alias("text"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks of each file (not fragments)."""
    return chunks.groupBy("file").agg(F.count_distinct("chunk_idx").alias("chunks"))


def listed(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every file with its number of chunks, 0 without."""
    return files.join(chunk_counts(chunks), "file", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def line_window(df: DataFrame, first: int, last: int, most_chars: int = WINDOW_CHARS) -> DataFrame:
    """Lines of each file between two numbers, until the characters run out; partial: whether any were left out."""
    last = min(last, first + WINDOW_LINES - 1)
    rows = lines(df).filter(F.col("line").between(first, last))
    along = Window.partitionBy("file")
    used = F.sum(F.length("line_text") + 1).over(along.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("used", used).withColumn("partial", F.max(F.col("used") > most_chars).over(along))
    return rows.filter(F.col("used") <= most_chars)


def budgeted(df: DataFrame, order: list[Column], size: Column, most: int, keys: list[str] | None = None) -> DataFrame:
    """Rows in order while the sum of their sizes stays within a budget (Q23); with `keys`, a budget for each."""
    return running(df, keys or [], order, size, "used").filter(F.col("used") <= most)


def section_label(text: Column) -> Column:
    """`§7.2.`, `Section 7.2` or `Appendix A` to its bare label."""
    return F.regexp_extract(F.upper(text), r"^\s*(?:§|SECTION|APPENDIX)?\s*([0-9]+(?:\.[0-9]+)*|[A-Z](?:\.[0-9]+)*)\.?\s*$", 1)


def section_span(headings: DataFrame, section: str) -> DataFrame:
    """Lines of a section and its subsections, the first contiguous run only. headings: file, line, section, last_line."""
    along = Window.partitionBy("file").orderBy("line")
    inside = (F.col("section") == section) | F.col("section").startswith(section + ".")
    rows = headings.withColumn("_in", inside).withColumn("_next", F.coalesce(F.lead("line").over(along) - 1, F.col("last_line")))
    rows = rows.withColumn("_gap", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(along)).filter("_in")
    first = F.min("_gap").over(Window.partitionBy("file"))
    rows = rows.withColumn("_first", first).filter("_gap = _first")
    return rows.groupBy("file").agg(F.min("line").alias("start"), F.max("_next").alias("end"))


def newest_revision(files: DataFrame) -> DataFrame:
    """Newest cached revision of each draft. files: draft, rev, path."""
    return files.groupBy("draft").agg(F.max_by("path", "rev").alias("path"), F.max("rev").alias("rev"))


#: Fixed forms of a draft's and a published document's file.
DRAFT_FILE, RFC_FILE = r"(?i)^(?:drafts/)?((?:draft|rfc)-[^/]+?)-([0-9]+)\.txt$", r"(?i)^(?:drafts/)?rfc[^/]*\.txt$"


def latest_documents(files: DataFrame) -> DataFrame:
    """Relpath of the newest revision of each draft, by number, and of every published document. files: relpath."""
    stem = F.lower(F.regexp_extract("relpath", DRAFT_FILE, 1))
    drafts = files.filter(F.col("relpath").rlike(DRAFT_FILE)).groupBy(stem.alias("_stem")).agg(F.max_by("relpath", F.struct(F.regexp_extract("relpath", DRAFT_FILE, 2).cast("int"), "relpath")).alias("relpath"))
    return drafts.select("relpath").unionByName(files.filter(F.col("relpath").rlike(RFC_FILE) & ~F.col("relpath").rlike(DRAFT_FILE)).select("relpath"))


def issue_lookup(issues: DataFrame, number: int) -> DataFrame:
    """An issue by number over all repositories; several make it ambiguous and give no row but the count."""
    found = issues.filter(F.col("number") == number)
    return found.agg(F.count_distinct("repo").alias("repos"), F.when(F.count_distinct("repo") == 1, F.min("repo")).alias("repo"))


def literal(needle: str, ignore_case: bool = True, loose_spaces: bool = False) -> str:
    """A pattern for a literal text; with loose spaces any white space matches a run of white space."""
    quoted = "".join(c if c.isalnum() or c in " _-" or ord(c) > 127 else "\\" + c for c in needle)
    if loose_spaces:
        quoted = r"\s+".join(quoted.split())
    return ("(?i)" if ignore_case else "") + quoted


def grep(df: DataFrame, pattern: str, per_file: int = PER_FILE, in_all: int = IN_ALL) -> DataFrame:
    """Matching lines, at most so many a file and then in all, each with the true totals over everything."""
    hits = lines(df.filter(F.col("text").rlike(pattern))).filter(F.col("line_text").rlike(pattern))
    own = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    hits = hits.withColumn("_own", own).withColumn("in_file", F.count("*").over(Window.partitionBy("file")))
    shown = hits.filter(F.col("_own") <= per_file).orderBy("file", "line").limit(in_all)
    return shown.select("file", "line", elided(F.col("line_text"), pattern).alias("line_text"), "in_file")


def grep_totals(df: DataFrame, pattern: str) -> DataFrame:
    """Files and lines scanned, files and lines that match."""
    hit = F.when(F.col("line_text").rlike(pattern), 1).otherwise(0)
    per = lines(df).groupBy("file").agg(F.count("*").alias("n"), F.sum(hit).alias("m"))
    return per.agg(F.count("*").alias("files"), F.sum("n").alias("lines"), F.count_if(F.col("m") > 0).alias("files_hit"), F.sum("m").alias("lines_hit"))


def elided(line: Column, pattern: str, most: int = LINE_CHARS) -> Column:
    """A long line shortened around its first match."""
    at = F.greatest(F.lit(1), F.regexp_instr(line, F.lit(pattern)) - most // 2)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.when(at > 1, "…").otherwise(""), F.substring(line, at, F.lit(most)), F.lit("…")))


def line_to_chunk(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk around a line: an equi-join on the file with a range. chunks: file, chunk_idx, start_line, end_line."""
    c = chunks.select(F.col("file").alias("_f"), "chunk_idx", "start_line", "end_line")
    return hits.join(c, (F.col("file") == F.col("_f")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left").drop("_f")


def context_lines(df: DataFrame, hits: DataFrame, around: int) -> DataFrame:
    """Lines near a hit, each once."""
    near = hits.select(F.col("file").alias("_f"), F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("_l")).distinct()
    rows = lines(df)
    return rows.join(near, (rows["file"] == F.col("_f")) & (rows["line"] == F.col("_l")), "left_semi")


#: Folders that hold a second copy of what has files of its own.
DERIVED = ("raw/", "github/")


def is_derived(relpath: Column, file_pattern: str | None = None) -> Column:
    """A file of a derived folder, in any case of letters, unless the pattern asks for such a folder."""
    if file_pattern and file_pattern.lower().startswith(DERIVED):
        return F.lit(False)
    return F.lower(relpath).startswith(DERIVED[0]) | F.lower(relpath).startswith(DERIVED[1])


def excluded(files: DataFrame, file_pattern: str | None = None) -> DataFrame:
    """Files scanned and, by why, those not. files: relpath, binary."""
    derived = ~F.col("binary") & is_derived(F.col("relpath"), file_pattern)
    return files.agg(F.count("*").alias("files"), F.count_if("binary").alias("binary"), F.count_if(derived).alias("derived"), F.count_if(~F.col("binary") & ~derived).alias("scanned"))


#: Fixed caps of a scan over joined sections: sections shown a document, excerpts a section, lines around a match.
SECTIONS_SHOWN, EXCERPTS_SHOWN, AROUND = 3, 2, 2


def phrase_hits(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """How often a pattern stands in whole texts, across line ends; rows without a hit go. Adds hits and first_line."""
    found = df.withColumn("hits", F.regexp_count(text, F.lit(pattern))).filter("hits > 0")
    before = F.substring(F.col(text), F.lit(1), F.regexp_instr(F.col(text), F.lit(pattern)) - 1)
    return found.withColumn("first_line", F.size(F.split(before, "\n", -1)))


def excerpts(df: DataFrame, pattern: str, around: int = AROUND, most: int = EXCERPTS_SHOWN, keys: tuple[str, ...] = ("file",), text: str = "text") -> DataFrame:
    """The first matches of each text, which may run over line ends: place, first and last line of each, the text between and `around` lines before and after."""
    places = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(0))
    rows = df.withColumn("_all", places).filter(F.size("_all") > 0).withColumn("matches", F.size("_all"))
    gaps = F.split(F.col(text), pattern, -1)
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    # the line a match begins on: line feeds in all gaps up to it and in the matches before it
    zipped = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size("_all")), feeds).alias("gap"), F.transform("_all", feeds).alias("own"), F.col("_all").alias("match"))
    rows = rows.withColumn("_z", zipped).select("*", F.posexplode(F.slice("_z", 1, most)).alias("_k", "_m"))
    first = F.expr("aggregate(slice(_z, 1, _k), 0, (a, x) -> a + x.gap + x.own) + _m.gap + 1")
    rows = rows.withColumn("place", F.col("_k") + 1).withColumn("first_line", first).withColumn("last_line", F.col("first_line") + F.col("_m.own"))
    low = F.greatest(F.lit(1), F.col("first_line") - around)
    shown = F.array_join(F.slice(F.split(F.col(text), "\n", -1), low, F.col("last_line") + around - low + 1), "\n")
    return rows.select(*keys, "place", "matches", "first_line", "last_line", F.col("_m.match").alias("match"), shown.alias("excerpt"))


def section_scan(chunks: DataFrame, pattern: str, per_file: int = SECTIONS_SHOWN, per_section: int = EXCERPTS_SHOWN) -> tuple[DataFrame, DataFrame]:
    """Scan of texts joined over the chunks of a section, so that a match may cross a chunk's end.

    chunks: file, chunk_idx, section, text. The first result: file, section, first, hits, in_file (the true total of the file)
    and shown, for the first sections of each file; the second: totals over everything, from all sections.
    """
    hits = phrase_hits(section_runs(chunks), pattern)
    total = hits.groupBy("file").agg(F.sum("hits").alias("in_file"), F.count("*").alias("sections"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("first"))
    shown = hits.withColumn("place", place).filter(F.col("place") <= per_file).join(total, "file")
    shown = shown.select("file", "section", "first", "place", "hits", "in_file", F.least("hits", F.lit(per_section)).alias("shown"), "text")
    return shown, total.agg(F.count("*").alias("files_hit"), F.sum("sections").alias("sections_hit"), F.sum("in_file").alias("hits"))


# Fixed forms of a draft's headings, and of leaders in a table of contents.
HEADING = r"^(?:(Appendix|Annex)\s+)?([0-9]+(?:\.[0-9]+)*|[A-Z]\.[0-9]+(?:\.[0-9]+)*|[A-Z])\.\s+(\S.*?)\s*$"
LEADER = r"\.{4,}"


def headings(files: DataFrame) -> DataFrame:
    """File, line, section, title, last_line: headings at the start of a line between blank lines.

    A single letter needs the word before it, and a title with a dot leader is one of a table of contents. Neighbours are
    read from the file's own array of lines, so no window is needed.
    """
    rows = files.select("file", F.split("text", "\n", -1).alias("_l")).withColumn("last_line", F.size("_l"))
    rows = rows.select("file", "last_line", "_l", F.posexplode("_l").alias("_k", "_x")).filter(F.col("_x").rlike(HEADING))
    blank = lambda k: F.coalesce(F.get("_l", k).rlike(r"^\s*$"), F.lit(True))
    word, label, title = (F.regexp_extract("_x", HEADING, g) for g in (1, 2, 3))
    rows = rows.filter(blank(F.col("_k") - 1) & blank(F.col("_k") + 1) & ~title.rlike(LEADER) & (~label.rlike("^[A-Z]$") | (word != "")))
    return rows.select("file", (F.col("_k") + 1).alias("line"), label.alias("section"), title.alias("title"), "last_line")


def draft_section(files: DataFrame, section: str) -> DataFrame:
    """File, start, end and the text of a section with its subsections."""
    span = section_span(headings(files), section)
    return files.join(span, "file").select("file", "start", "end", F.array_join(F.slice(F.split("text", "\n", -1), F.col("start"), F.col("end") - F.col("start") + 1), "\n").alias("text"))


def chunk_spans(chunks: DataFrame) -> DataFrame:
    """File, chunk_idx, start_line, end_line, title of whole chunks that have lines."""
    return chunks.filter("sub_idx = 0 AND start_line IS NOT NULL").select("file", "chunk_idx", "start_line", "end_line", "title")


def matched_passage(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """From the matched chunk to the end of its section. chunks: file, chunk_idx, section, text; hits: file, chunk_idx, section."""
    h = hits.select(F.col("file").alias("_f"), F.col("section").alias("_s"), F.col("chunk_idx").alias("hit"))
    rows = chunks.join(h, (F.col("file") == F.col("_f")) & F.col("section").eqNullSafe(F.col("_s")) & (F.col("chunk_idx") >= F.col("hit")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("file", "section", "hit").agg(F.count("*").alias("chunks"), text.alias("text"))
