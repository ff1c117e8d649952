"""Queries of chunking, reads and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import chunking as C
from skein.operators import reads as R
from skein.operators import scans as SC
from skein.scratch import place
from skein.session import table
from skein.sources import chunk_store

from .registry import query

NL = "chr(10)"
LINES = f"""lines AS (SELECT doc_id, lang, i::INT AS line, l[i] AS line_text FROM (SELECT doc_id, lang,
    CASE WHEN text LIKE '%' || {NL} THEN string_split(text, {NL})[:-2] ELSE string_split(text, {NL}) END AS l FROM documents WHERE text IS NOT NULL), range(1, len(l) + 1) r(i))"""
WINDOWS = """sized AS (SELECT *, length(text) AS n FROM documents), windows AS (SELECT doc_id, text, k::INT AS sub_idx, (k * 1050)::INT AS "offset", substr(text, k * 1050 + 1, 1200) AS w
    FROM sized, range(0, CASE WHEN n = 0 THEN 0 WHEN n <= 1200 THEN 1 ELSE ceil((n - 1200) / 1050)::BIGINT + 1 END) r(k))"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("file"), "text", "lang", "source")


@query(f"WITH {WINDOWS} SELECT doc_id, sub_idx, \"offset\", sha256(w) AS chunk_hash FROM windows")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.windows(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "sub_idx", "offset", F.sha2("window", 256).alias("chunk_hash"))


@query(f"WITH {WINDOWS} SELECT doc_id, sub_idx, len(string_split(substr(text, 1, \"offset\"), {NL}))::INT AS start_line FROM windows")
def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    w = C.windows(table(spark, sf, "documents").select("doc_id", "text"))
    return w.select("doc_id", "sub_idx", C.line_of(F.col("text"), F.col("offset")).alias("start_line"))


@query()
def chunk_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Unicode white space differs between regex dialects: no SQL."""
    return C.windowed_chunks(table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "text")).select("doc_id", "sub_idx", "title", "start_line")


@query("""WITH h AS (SELECT doc_id, lang, sha256(text) AS chunk_hash FROM documents), s AS (SELECT lang, chunk_hash, min(doc_id) AS first FROM h SEMI JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT h.doc_id, s.first AS vec_of FROM h LEFT JOIN s USING (lang, chunk_hash)""")
def chunk_hash_reuse(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("file"), F.sha2("text", 256).alias("chunk_hash"))
    stored = h.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("file", "chunk_hash", F.col("doc_id").alias("chunk_idx"), F.col("doc_id").alias("embedding"))
    return C.reused(h, stored).select("doc_id", F.col("embedding").alias("vec_of"))


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS first, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return d.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")


PLAN = """n AS (SELECT lang || '/' || doc_id AS f, sha256(text) AS h FROM documents), o AS (SELECT CASE WHEN quality = 0 THEN 'old' ELSE lang END || '/' || doc_id AS f, sha256(CASE WHEN toxic = 1 THEN text || '!' ELSE text END) AS h FROM documents JOIN labels USING (doc_id)),
plan AS (SELECT coalesce(n.f, o.f) AS relpath, CASE WHEN o.f IS NULL THEN 'new' WHEN n.f IS NULL THEN 'orphan' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS action FROM n FULL JOIN o USING (f))"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    """The older state: the labelled documents, those of low quality under another name, toxic ones with another text."""
    d = table(spark, sf, "documents")
    new = d.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("relpath"), F.sha2("text", 256).alias("sha256"))
    old = d.join(table(spark, sf, "labels"), "doc_id")
    text, kind = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), F.when(F.col("quality") == 0, "old").otherwise(F.col("lang"))
    return C.build_plan(new, old.select(F.concat_ws("/", kind, F.col("doc_id").cast("string")).alias("relpath"), F.sha2(text, 256).alias("sha256")))


@query(f"WITH {PLAN} SELECT * FROM plan")
def incremental_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf)


def _lengths(texts: list[str]) -> list[list[float]]:
    """Stands for a model."""
    return [[float(len(t))] for t in texts]


def _chunked(files: DataFrame) -> DataFrame:
    return C.windows(files).select("file", F.lit(0).alias("chunk_idx"), "sub_idx", F.col("window").alias("embed_text"))


@query(f"WITH {WINDOWS} SELECT lang || '/' || doc_id AS file, sub_idx, sha256(w) AS chunk_hash, length(w)::DOUBLE AS vector FROM windows JOIN documents USING (doc_id)")
def index_update(spark: SparkSession, sf: str) -> DataFrame:
    """An index of the older state of `incremental_plan`, brought up to date: equal to one of all documents as they are."""
    d, path = table(spark, sf, "documents"), place(spark, "chunk-index")
    name = lambda kind: F.concat_ws("/", kind, F.col("doc_id").cast("string")).alias("relpath")
    old = d.join(table(spark, sf, "labels").dropDuplicates(["doc_id"]), "doc_id")
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = old.select(name(F.when(F.col("quality") == 0, "old").otherwise(F.col("lang"))), text.alias("text"))
    for files in (old, d.select(name(F.col("lang")), "text")):
        chunk_store.update(spark, path, files.withColumn("sha256", F.sha2("text", 256)), _chunked, _lengths, buckets=16)
    return chunk_store.chunks(spark, path).select("file", "sub_idx", "chunk_hash", F.col("embedding")[0].alias("vector"))


@query(f"WITH {PLAN} SELECT relpath FROM plan WHERE action = 'orphan'")
def orphan_prune(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).filter("action = 'orphan'").select("relpath")


@query("""WITH c AS (SELECT doc_id AS file, bool_and(doc_id % 11 <> 0) AS whole FROM documents GROUP BY 1) SELECT c.file::VARCHAR AS relpath, CASE WHEN whole THEN sha256(text) END AS sha256 FROM c JOIN documents d ON d.doc_id = c.file""")
def stamp_complete_files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("relpath"), F.sha2("text", 256).alias("sha256"))
    return C.stamped(files, d.select(F.col("doc_id").cast("string").alias("file"), F.when(F.col("doc_id") % 11 != 0, 1).alias("embedding")))


@query("""WITH p AS (SELECT doc_id // 8 AS doc, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS section, (doc_id % 8) * 900 AS off, n_chars AS len FROM documents),
q AS (SELECT *, greatest(off, coalesce(max(off + len) OVER (PARTITION BY doc, section ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start FROM p)
SELECT doc, section, off, len, start, greatest(0, off + len - start) AS kept FROM q""")
def overlap_trim(spark: SparkSession, sf: str) -> DataFrame:
    return C.trimmed_overlaps(_ranges(spark, sf))


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.expr("doc_id div 8").alias("doc"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("section"), ((F.col("doc_id") % 8) * 900).alias("off"), F.col("n_chars").alias("len"))


@query("""WITH p AS (SELECT doc_id // 8 AS doc, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS section, (doc_id % 8) * 900 AS off, n_chars AS len FROM documents)
SELECT doc, section, min(off) AS low, max(off + len) AS high FROM p WHERE section IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT doc, section, off, off + len FROM p WHERE section IS NULL""")
def section_spans(spark: SparkSession, sf: str) -> DataFrame:
    return C.section_spans(_ranges(spark, sf))


@query("""SELECT count_if(a.q = e.q) AS matched, count_if(a.q <> e.q) AS differing, count_if(a.q IS NULL) AS absent FROM (SELECT doc_id, (n_chars % 2)::INT AS q FROM documents) e LEFT JOIN (SELECT doc_id, quality::INT AS q FROM labels) a USING (doc_id)""")
def digest_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    want = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), (F.col("n_chars") % 2).cast("int").alias("digest"))
    return C.reconciled(want, table(spark, sf, "labels").select(F.col("doc_id").alias("doc"), F.col("quality").cast("int").alias("digest")))


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("file"), F.col("turn").alias("chunk_idx"), F.when(F.col("role") != "system", F.col("role")).alias("section"), F.coalesce("text", F.lit("")).alias("text"), F.substring("text", 1, 20).alias("title"))


SECTIONS = "s AS (SELECT conv_id AS file, turn AS chunk_idx, nullif(role, 'system') AS section, coalesce(text, '') AS text, substr(text, 1, 20) AS title FROM conversations)"


@query(f"WITH {SECTIONS} SELECT file, section, arg_min(title, chunk_idx) AS title, min(chunk_idx) AS first, sum(length(text))::BIGINT AS chars FROM s GROUP BY 1, 2")
def section_outline(spark: SparkSession, sf: str) -> DataFrame:
    return R.outline(_sections(spark, sf))


@query(f"""WITH {SECTIONS}, f AS (SELECT *, CASE WHEN section IS NULL OR section IS DISTINCT FROM lag(section) OVER (PARTITION BY file ORDER BY chunk_idx) THEN 1 ELSE 0 END AS n FROM s),
r AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY chunk_idx)::BIGINT AS run FROM f) SELECT file, run, any_value(section) AS section, min(chunk_idx) AS first, string_agg(text, {NL} ORDER BY chunk_idx) AS text FROM r GROUP BY file, run""")
def section_runs(spark: SparkSession, sf: str) -> DataFrame:
    return R.section_runs(_sections(spark, sf))


@query("SELECT label AS file, count(DISTINCT vec_id // 2) AS chunks FROM embeddings GROUP BY 1")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.chunk_counts(table(spark, sf, "embeddings").select(F.col("label").alias("file"), F.expr("vec_id div 2").alias("chunk_idx")))


@query("SELECT n_nationkey AS file, count(DISTINCT s_suppkey) AS chunks FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def list_files(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "nation").select(F.col("n_nationkey").alias("file"))
    return R.listed(files, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("chunk_idx")))


@query(f"""WITH {LINES}, w AS (SELECT *, sum(length(line_text) + 1) OVER (PARTITION BY doc_id ORDER BY line)::BIGINT AS used FROM lines WHERE line BETWEEN 2 AND 9),
p AS (SELECT *, bool_or(used > 900) OVER (PARTITION BY doc_id) AS partial FROM w) SELECT doc_id AS file, line, used, partial FROM p WHERE used <= 900""")
def line_window(spark: SparkSession, sf: str) -> DataFrame:
    return R.line_window(_files(spark, sf), 2, 9, 900).select("file", "line", "used", "partial")


@query("""WITH u AS (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id)::BIGINT AS used FROM documents) SELECT doc_id, used FROM u WHERE used <= 40000""")
def running_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return R.budgeted(d, [F.asc("doc_id")], F.col("n_chars"), 40_000, ["lang"]).select("doc_id", "used")


@query("""WITH h AS (SELECT l_orderkey AS file, l_linenumber * 10 AS line, CASE WHEN l_quantity < 25 THEN '7' || CASE WHEN l_linenumber % 2 = 0 THEN '.2' ELSE '' END ELSE '8' END AS section FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
n AS (SELECT *, (section = '7' OR section LIKE '7.%') AS inside, coalesce(lead(line) OVER (PARTITION BY file ORDER BY line) - 1, 99) AS nxt FROM h),
g AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line) AS gap FROM n), m AS (SELECT *, min(gap) OVER (PARTITION BY file) AS first FROM g WHERE inside)
SELECT file, min(line) AS start, max(nxt) AS "end" FROM m WHERE gap = first GROUP BY file""")
def section_span(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem")
    one = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    li = li.withColumn("_n", one).filter("_n = 1")
    section = F.when(F.col("l_quantity") < 25, F.concat(F.lit("7"), F.when(F.col("l_linenumber") % 2 == 0, ".2").otherwise(""))).otherwise("8")
    return R.section_span(li.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 10).alias("line"), section.alias("section"), F.lit(99).alias("last_line")), "7")


@query("SELECT 'draft-' || p_brand AS draft, arg_max('p' || p_partkey, p_partkey) AS path, max(p_partkey) AS rev FROM part GROUP BY 1")
def newest_revision(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return R.newest_revision(p.select(F.concat(F.lit("draft-"), "p_brand").alias("draft"), F.col("p_partkey").alias("rev"), F.concat(F.lit("p"), "p_partkey").alias("path")))


@query("SELECT count(DISTINCT l_suppkey) AS repos, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS repo FROM lineitem WHERE l_orderkey = 7")
def issue_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return R.issue_lookup(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_orderkey").alias("number")), 7)


GREP = f"WITH {LINES}, hits AS (SELECT * FROM lines WHERE regexp_matches(line_text, '(?i)license'))"


@query(f"""{GREP}, t AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1), m AS (SELECT doc_id, count(*) AS m FROM hits GROUP BY 1)
SELECT count(*) AS files, sum(n)::BIGINT AS lines, count_if(coalesce(m, 0) > 0) AS files_hit, sum(coalesce(m, 0))::BIGINT AS lines_hit FROM t LEFT JOIN m USING (doc_id)""")
def grep_literal_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.grep_totals(_files(spark, sf), R.literal("license"))


PATTERN = "(the|and)[a-z]* [a-z]+ing"


@query(f"""WITH {LINES}, m AS (SELECT * FROM lines WHERE regexp_matches(line_text, '{PATTERN}')), r AS (SELECT doc_id AS file, line, count(*) OVER (PARTITION BY doc_id) AS in_file, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM m)
SELECT file, line, in_file FROM r WHERE n <= 2 ORDER BY file, line LIMIT 200""")
def timed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A scan with a budget that is enough."""
    return SC.scan_lines(_files(spark, sf).select("file", "text"), PATTERN, ignore_case=False, seconds=3600, per_file=2)[2].select("file", "line", "in_file")


@query(f"""{GREP}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS o, count(*) OVER (PARTITION BY doc_id) AS in_file FROM hits)
SELECT doc_id AS file, line, in_file FROM r WHERE o <= 2 ORDER BY file, line LIMIT 200""")
def grep_capped_hits(spark: SparkSession, sf: str) -> DataFrame:
    return R.grep(_files(spark, sf), R.literal("license"), per_file=2).select("file", "line", "in_file")


@query(f"""{GREP} SELECT doc_id AS file, line, ((line - 1) // 5)::BIGINT AS chunk_idx FROM hits""")
def grep_line_to_chunk(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf)
    pattern = R.literal("license")
    hits = R.lines(f).filter(F.col("line_text").rlike(pattern)).select("file", "line")
    return R.line_to_chunk(hits, R.line_chunks(f, 5)).select("file", "line", "chunk_idx")


@query(f"""{GREP}, near AS (SELECT DISTINCT h.doc_id, h.line + d AS line FROM hits h, range(-1, 2) r(d)) SELECT l.doc_id AS file, l.line FROM lines l SEMI JOIN near USING (doc_id, line)""")
def grep_context(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf)
    hits = R.lines(f).filter(F.col("line_text").rlike(R.literal("license"))).select("file", "line")
    return R.context_lines(f, hits, 1).select("file", "line")


@query(r"""WITH h AS (SELECT doc_id, text, len(regexp_extract_all(text, '(?i)general\s+public'))::INT AS hits FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS file, hits, len(string_split(regexp_extract(text, '(?is)^(.*?)general\s+public', 1), chr(10)))::INT AS first_line FROM h WHERE hits > 0""")
def phrase_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, so a phrase may run over a line end."""
    return R.phrase_hits(_files(spark, sf), R.literal("general public", loose_spaces=True)).select("file", "hits", "first_line")


@query(r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?i)general\s+public') AS m, regexp_split_to_array(text, '(?i)general\s+public') AS g FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, m, g, i FROM m, range(1, 3) r(i) WHERE i <= len(m)), f AS (SELECT doc_id, m, i, length(array_to_string(g[1:i], '') || array_to_string(m[1:i - 1], '')) - length(replace(array_to_string(g[1:i], '') || array_to_string(m[1:i - 1], ''), chr(10), '')) + 1 AS first_line FROM k)
SELECT doc_id AS file, i::INT AS place, len(m)::INT AS matches, first_line::INT AS first_line, (first_line + length(m[i]) - length(replace(m[i], chr(10), '')))::INT AS last_line FROM f""")
def grep_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return R.excerpts(_files(spark, sf), R.literal("general public", loose_spaces=True)).select("file", "place", "matches", "first_line", "last_line")


@query("""WITH f AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'digests/' WHEN 1 THEN 'raw/' WHEN 2 THEN 'GitHub/' ELSE 'threads/raw/' END || doc_id AS relpath, doc_id % 9 = 0 AS b FROM documents),
s AS (SELECT *, NOT b AND (relpath ILIKE 'raw/%' OR relpath ILIKE 'github/%') AS d FROM f) SELECT count(*) AS files, count_if(b) AS "binary", count_if(d) AS derived, count_if(NOT b AND NOT d) AS scanned FROM s""")
def scan_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    d, k = table(spark, sf, "documents"), F.col("doc_id") % 5
    kind = F.when(k == 0, "digests/").when(k == 1, "raw/").when(k == 2, "GitHub/").otherwise("threads/raw/")
    return R.excluded(d.select(F.concat(kind, "doc_id").alias("relpath"), (F.col("doc_id") % 9 == 0).alias("binary")))


@query("""WITH f AS (SELECT 'drafts/draft-' || (doc_id % 30) || '-0' || (doc_id % 10) || CASE WHEN doc_id % 6 = 0 THEN '.pdf' ELSE '.txt' END AS relpath FROM documents UNION ALL SELECT CASE doc_id % 3 WHEN 0 THEN 'digests/' WHEN 1 THEN 'threads/' ELSE 'pulls/' END || doc_id || '.md' FROM documents)
SELECT DISTINCT relpath FROM f WHERE regexp_matches(relpath, '\\.(txt|md)$') AND split_part(relpath, '/', 1) NOT IN ('digests', 'github', 'raw', 'pulls', 'state')
AND coalesce(regexp_extract(relpath, '^drafts/(draft-.*?)(?:-[0-9]{2})?\\.(?:txt|md)$', 1), '') NOT IN (SELECT 'draft-' || d FROM range(0, 30) r(d) WHERE d % 4 = 0)""")
def eligible_files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    draft = F.concat(F.lit("drafts/draft-"), F.col("doc_id") % 30, F.lit("-0"), F.col("doc_id") % 10, F.when(F.col("doc_id") % 6 == 0, ".pdf").otherwise(".txt"))
    other = F.concat(F.when(F.col("doc_id") % 3 == 0, "digests/").when(F.col("doc_id") % 3 == 1, "threads/").otherwise("pulls/"), "doc_id", F.lit(".md"))
    files = d.select(draft.alias("relpath")).unionByName(d.select(other.alias("relpath"))).distinct()
    manifest = spark.range(30).select(F.concat(F.lit("draft-"), "id").alias("draft"), F.when(F.col("id") % 4 == 0, "rfc").otherwise("active").alias("state"))
    return C.eligible(files, manifest)


@query("SELECT lang AS kind, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    from skein.sources.versions import inventory

    d = table(spark, sf, "documents")
    return inventory(d.select(F.concat("lang", F.lit("/"), "doc_id").alias("relpath"), F.col("n_chars").alias("chars")))


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY 1")
def thread_bundles(spark: SparkSession, sf: str) -> DataFrame:
    from skein.sources.versions import bundles

    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return bundles(c, ["conv_id"], ["turn"])


@query("""WITH v AS (SELECT o_custkey AS corpus, o_orderkey AS version, o_orderkey % 11 = 0 AS current FROM orders) SELECT corpus, version, current FROM v QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY current DESC, version DESC) <= 2""")
def version_retention(spark: SparkSession, sf: str) -> DataFrame:
    from skein.sources.versions import retained

    o = table(spark, sf, "orders")
    return retained(o.select(F.col("o_custkey").alias("corpus"), F.col("o_orderkey").alias("version"), (F.col("o_orderkey") % 11 == 0).alias("current")), 2)
