"""One object over the tables of a corpus store: every tool of the query surface as a method that returns a DataFrame.

Tables are handed over by name and read lazily; a method fails with a clear error if it needs one that is missing. The
text of a query is embedded by an injected function. Rendering is left to the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.postal import addresses
from skein.functions.prose import snippets
from skein.operators import chunking, digests, reads, records, scans, search, threads
from skein.operators import positions as stances

Embed = Callable[[str], list[float]]

DIGESTS = {
    "threads": ("state", "since", "until", "least", "subject"), "issues": ("state", "label", "since", "until", "author"), "pulls": ("state", "label", "since", "until", "author"), "timeline": ("since", "until", "kinds", "exclude"),
    "people": ("role", "org", "domain", "least"), "documents": (), "labels": (), "index": (),
}
#: The order of each table, and what counts as activity in it.
ORDERS = {"threads": ("-last", "thread"), "issues": ("-updated", "number"), "pulls": ("-updated", "number"), "people": ("-msgs", "name"), "documents": ("draft", "rev"), "index": ("relpath",)}
ACTIVITY = {"threads": "msgs", "issues": "comments", "pulls": "comments", "people": "msgs"}
#: Characters of a message's text in a topic: shown without a wish, at least and at most.
BODY_CHARS, BODY_LEAST, BODY_MOST = 4000, 100, 20_000


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], embed: Embed | None = None, meta: dict[str, str] | None = None) -> None:
        """meta: what the index says of itself, such as the number of lists to probe."""
        self.spark, self.tables, self.embed, self.probes = spark, tables, embed, search.probe_count(meta or {})

    def table(self, name: str, corpus: str | None = None) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"the store has no table {name}")
        df = self.tables[name]
        return df.filter(F.col("corpus") == corpus) if corpus is not None else df

    def _query(self, text: str) -> DataFrame:
        if self.embed is None:
            raise ValueError("a text query needs an embedding function")
        return self.spark.createDataFrame([([float(x) for x in self.embed(text)],)], "_q array<double>")

    # retrieval

    def list_corpora(self) -> DataFrame:
        return self.table("corpora").orderBy("corpus")

    def which_corpus(self, query: str, limit: int = 8) -> DataFrame:
        """The largest group of corpora with one model, best first; `confident` says whether to trust any."""
        c = self.table("centroids")
        model = c.groupBy("model").agg(F.count_distinct("corpus").alias("n")).orderBy(F.desc("n"), "model").limit(1).select("model")
        return search.routed(c.join(F.broadcast(model), "model"), self._query(query)).orderBy(F.desc("score"), "corpus").limit(limit)

    def find_efforts(self, query: str, limit: int = 15) -> DataFrame:
        """Efforts by words, fused with the groups whose charters are near the query, if there are charter vectors; a one-word query that is an acronym comes first."""
        e = self.table("efforts")
        terms = [search.clean_word(t) for t in query.lower().split() if search.clean_word(t)]
        score = sum((search.term_score(F.col("acronym"), F.col("name"), F.col("about"), t) for t in terms), F.lit(0))
        words = e.withColumn("score", score).filter("score > 0")
        lists = [words.select(F.col("acronym").alias("id"), F.col("score").cast("double").alias("score"))]
        if "charters" in self.tables and self.embed is not None:
            near = self._charters_near(query).join(e.select("acronym").distinct(), "acronym", "left_semi")
            lists.append(near.select(F.col("acronym").alias("id"), "score"))
        state = F.col("state") if "state" in e.columns else F.lit(None).cast("string")
        closed = e.filter(state.isin(*search.CLOSED_STATES)).select(F.col("acronym").alias("id")).distinct().withColumn("_closed", F.lit(True))
        pinned = F.lit(len(terms) == 1) & (F.regexp_replace(F.lower("id"), "[^a-z0-9]", "") == (terms[0] if len(terms) == 1 else ""))
        got = search.fused(lists).join(closed, "id", "left")
        got = got.withColumn("score", F.col("score") * F.when(F.col("_closed"), search.CLOSED_FACTOR).otherwise(1.0) + F.when(pinned, search.PINNED).otherwise(0.0))
        return e.join(got.select(F.col("id").alias("acronym"), "score"), "acronym").orderBy(F.desc("score"), "acronym").limit(limit)

    def _charters_near(self, query: str) -> DataFrame:
        """Groups by their best charter window, those above the floor and near the best only."""
        best = search.scan(self.table("charters"), self._query(query)).groupBy("acronym").agg(F.max("score").alias("score"))
        top = best.agg(F.max("score").alias("_top"))
        return best.crossJoin(F.broadcast(top)).filter((F.col("score") >= search.CHARTER_FLOOR) & (F.col("score") >= F.col("_top") - search.CHARTER_WINDOW)).drop("_top")

    def _hits(self, chunks: DataFrame, ranked: DataFrame, vectors: DataFrame, limit: int, diversify: bool, group_by: str | None, collapse_versions: bool, snippet: bool) -> DataFrame:
        """Ranks keys and scores only; vectors and texts are joined to the few that are left. Enough are fetched that thinning leaves `limit`."""
        by_file = group_by == "file"
        hits = search.best_hits(ranked, search.over_fetch(limit) if by_file or collapse_versions else limit, vectors if diversify and not by_file else None)
        hits = search.newest_revisions(hits, ("corpus",)) if collapse_versions else hits
        if by_file:
            return search.by_file(hits).limit(limit)
        shown = chunks.filter("sub_idx = 0").drop("embedding", "sub_idx", "score").join(F.broadcast(hits.orderBy("place").limit(limit)), ["corpus", "file", "chunk_idx"])
        return (shown.withColumn("text", snippets(F.col("text"))) if snippet else shown).orderBy("place")

    def _probed(self, corpus: str, chunks: DataFrame, query: DataFrame) -> DataFrame:
        """Only the chunks of the lists nearest the query, where the index has lists."""
        lists = self.tables.get("centroids")
        if lists is None or "cluster_id" not in lists.columns or "cluster_id" not in chunks.columns:
            return chunks
        return search.probed(chunks, lists.filter(F.col("corpus") == corpus), query, self.probes)

    def search_corpus(self, corpus: str, query: str, limit: int = 10, group_by: str | None = None, sort: str | None = None, collapse_versions: bool = True, diversify: bool = True, snippet: bool = True, **facets) -> DataFrame:
        limit, asked = search.clamped(limit), self._query(query)
        chunks = search.facets(self.table("chunks", corpus), dated=sort == "date", **facets)
        near = chunks if facets or sort else self._probed(corpus, chunks, asked)
        key = ("corpus", "file", "chunk_idx")
        near = near.select(*key, "sub_idx", "embedding")
        ranked = search.collapsed(search.scan(near, asked).drop("embedding"), key)
        out = self._hits(chunks, ranked, near, limit, diversify, group_by, collapse_versions, snippet)
        return out.orderBy(F.desc("chunk_date"), "file", "chunk_idx") if sort == "date" and group_by is None else out

    def find_related(self, corpus: str, file: str, chunk_idx: int, limit: int = 10, group_by: str | None = None, diversify: bool = True, collapse_versions: bool = True, snippet: bool = True, **facets) -> DataFrame:
        """Chunks nearest one chunk, which itself is left out; facets hold for the others only."""
        limit, c = search.clamped(limit), self.table("chunks", corpus)
        seed = (F.col("file") == file) & (F.col("chunk_idx") == chunk_idx)
        rest = search.facets(c.filter(~seed), **facets)
        key = ("corpus", "file", "chunk_idx")
        near = rest.select(*key, "sub_idx", "embedding")
        ranked = search.collapsed(search.related(c.filter(seed).select(*near.columns).unionByName(near), seed).drop("embedding"), key)
        return self._hits(rest, ranked, near, limit, diversify, group_by, collapse_versions, snippet)

    def search_corpora(self, corpora: list[str], query: str, limit: int = 10, collapse_versions: bool = True, **facets) -> DataFrame:
        """The best hits of several corpora, each ranked by itself (with novelty, newest revisions only), then merged."""
        limit, names = search.clamped(limit), list(dict.fromkeys(corpora))[: search.CORPORA_MOST]
        chunks = search.facets(self.table("chunks").filter(F.col("corpus").isin(*names)), **facets)
        order = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("corpus"))
        models = self.table("corpora").filter(F.col("corpus").isin(*names)).select("corpus", "model", order.alias("place")).limit(search.CORPORA_MOST)
        key = ("corpus", "file", "chunk_idx")
        near = chunks.select(*key, "sub_idx", "embedding")
        ranked = search.collapsed(search.scan(near, self._query(query)).drop("embedding"), key)
        hits = search.best_hits(ranked, search.over_fetch(limit) if collapse_versions else limit, near, by_corpus=True)
        hits = (search.newest_revisions(hits, ("corpus",)) if collapse_versions else hits).withColumnRenamed("place", "own").join(F.broadcast(models), "corpus")
        merged = search.merged_corpora(hits.withColumn("id", F.concat_ws("#", "file", "chunk_idx")), limit)
        titles = chunks.filter("sub_idx = 0").select(*key, "title")
        return titles.join(F.broadcast(merged), list(key)).select("corpus", "model", "score", "id", "title", "rank", "place").orderBy("rank", "place")

    def search_rfc_text(self, query: str, limit: int = 10, rfc: str | None = None, sections: int = 3) -> dict[str, DataFrame]:
        """Documents by their best sections among 200 chunks, and those sections as far as the reply's budget goes. rfc: within one document."""
        c = self.table("chunks", "rfc")
        c = c.filter(F.regexp_extract("file", r"([^/]+?)(?:\.txt)?$", 1) == rfc) if rfc else c
        key = ("file", "chunk_idx")
        hits = search.top(search.collapsed(search.scan(c, self._query(query)), key), search.RETRIEVED).withColumn("doc", F.regexp_extract("file", r"([^/]+?)(?:\.txt)?$", 1))
        cites = self.table("rfc_refs").groupBy(F.col("dst").alias("doc")).agg(F.count("*").alias("citations"))
        rows = hits.join(cites, "doc", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
        documents = search.documents_ranked(rows, search.title_overlap(query, F.col("title"))).limit(max(1, min(search.DOCUMENTS_MOST, limit)))
        return {"documents": documents, "sections": search.shown_sections(hits, documents, sections)}

    # reads

    def list_files(self, corpus: str, pattern: str | None = None) -> DataFrame:
        files = self.table("files", corpus).withColumnRenamed("relpath", "file")
        files = files.filter(search.like(F.col("file"), pattern)) if pattern else files
        return reads.listed(files, self.table("chunks", corpus).select("file", "chunk_idx")).orderBy("file")

    def get_chunk_text(self, corpus: str, file: str, chunk_idx: int, end_chunk_idx: int | None = None) -> DataFrame:
        last = min(end_chunk_idx if end_chunk_idx is not None else chunk_idx, chunk_idx + 19)
        rows = self.table("chunks", corpus).filter((F.col("file") == file) & F.col("chunk_idx").between(chunk_idx, last) & (F.col("sub_idx") == 0))
        return rows.drop("embedding").orderBy("chunk_idx")

    def get_chunks_batch(self, corpus: str, requests: list[tuple[str, int]]) -> DataFrame:
        wanted = self.spark.createDataFrame(requests, "file string, chunk_idx int")
        return self.table("chunks", corpus).filter("sub_idx = 0").drop("embedding").join(F.broadcast(wanted), ["file", "chunk_idx"], "left_semi")

    def get_by_url(self, corpus: str, url: str) -> DataFrame:
        """The chunk of an address, or all chunks of a file's; `whole` says which, with the file's text in order on the first row.

        An address that no chunk has may be that of a file which isn't indexed: its text is one row without a chunk.
        """
        one = self.spark.createDataFrame([(url,)], "u string").select(X.canonical_url(F.col("u")).alias("_url"))
        rows = self.table("chunks", corpus).filter("sub_idx = 0").drop("embedding").withColumn("_url", X.canonical_url(F.col("url")))
        found = rows.join(F.broadcast(one), "_url", "left_semi").drop("_url")
        whole = found.groupBy("file").agg((F.count("*") > 1).alias("whole"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda c: c["text"]), "\n").alias("file_text"), F.min("chunk_idx").alias("_first"))
        found = found.join(F.broadcast(whole), "file").withColumn("file_text", F.when(F.col("whole") & (F.col("chunk_idx") == F.col("_first")), F.col("file_text"))).drop("_first")
        files = self.tables.get("files")
        if files is not None and "url" in files.columns:
            own = files.filter(F.col("corpus") == corpus).withColumn("_url", X.canonical_url(F.col("url"))).join(F.broadcast(one), "_url", "left_semi")
            own = own.select("corpus", F.col("relpath").alias("file"), "url", F.lit(True).alias("whole"), F.col("text").alias("file_text"))
            found = found.unionByName(own.join(found.select("file").distinct(), "file", "left_anti"), allowMissingColumns=True)
        return found.orderBy("file", "chunk_idx")

    def read_file_section(self, corpus: str, file: str, start_line: int = 1, max_lines: int = 400) -> DataFrame:
        files = self.table("files", corpus).withColumnRenamed("relpath", "file").filter(F.col("file") == file)
        return reads.line_window(files.select("file", "text"), start_line, start_line + max_lines - 1).orderBy("line")

    def get_rfc_section(self, rfc: str, section: str | None = None) -> DataFrame:
        """The outline, a section, or (section="") what stands in no section, a chunk a row."""
        c = self.table("chunks", "rfc").filter((F.regexp_extract("file", r"([^/]+?)(?:\.txt)?$", 1) == rfc) & (F.col("sub_idx") == 0))
        if section is None:
            return reads.outline(c).orderBy("first")
        return reads.section_runs(c.filter(F.col("section").isNull() if section == "" else F.col("section") == section).select("file", "chunk_idx", "section", "text"))

    def get_draft(self, corpus: str, name: str, section: str | None = None, start_line: int | None = None, max_lines: int = 400, outline: bool = False) -> DataFrame:
        """The newest revision: its path, its outline, a section with its subsections, or a window of lines."""
        newest = reads.newest_revision(self.table("drafts", corpus).filter(F.col("draft") == name))
        if section is None and start_line is None and not outline:
            return newest
        files = self.table("files", corpus).withColumnRenamed("relpath", "file")
        own = files.join(F.broadcast(newest.select(F.col("path").alias("file")).limit(1)), "file", "left_semi").select("file", "text")
        if outline:
            return reads.headings(own).orderBy("line")
        if section is not None:
            return reads.draft_section(own, section)
        return reads.line_window(own, start_line, start_line + max_lines - 1).orderBy("line")

    def matched_passage(self, rfc: str, section: str | None, chunk_idx: int) -> DataFrame:
        c = self.table("chunks", "rfc").filter((F.regexp_extract("file", r"([^/]+?)(?:\.txt)?$", 1) == rfc) & (F.col("sub_idx") == 0))
        hit = c.filter(F.col("section").eqNullSafe(F.lit(section)) & (F.col("chunk_idx") == chunk_idx)).select("file", "chunk_idx", "section")
        return reads.matched_passage(c, hit)

    def grep_rfc_corpus(self, pattern: str, regex: bool = False, case_sensitive: bool = False) -> tuple[DataFrame, DataFrame]:
        """Sections of documents that match, joined over their chunks, and the totals over everything."""
        wanted = ("" if case_sensitive else "(?i)") + pattern if regex else reads.literal(pattern, not case_sensitive, loose_spaces=True)
        return reads.section_scan(self.table("chunks", "rfc").filter("sub_idx = 0").select("file", "chunk_idx", "section", "text"), wanted)

    def get_issue(self, corpus: str, number: int, repo: str | None = None) -> DataFrame:
        """The issue, or one row for each repository that has the number: the caller must choose."""
        rows = self.table("issues", corpus).filter(F.col("number") == number)
        return rows.filter(F.col("repo") == repo) if repo else rows.orderBy("repo")

    def grep_corpus(self, corpus: str, pattern: str, regex: bool = False, case_sensitive: bool = False, file_pattern: str | None = None, limit: int = 50, files_only: bool = False, max_per_file: int | None = None) -> DataFrame:
        files, wanted = self._scanned_files(corpus, file_pattern), self._pattern(pattern, regex, case_sensitive)
        if files_only:
            return reads.lines(files).filter(F.col("line_text").rlike(wanted)).groupBy("file").agg(F.count("*").alias("hits")).orderBy("file")
        return reads.grep(files, wanted, max_per_file or limit, limit)

    def grep_report(self, corpus: str, pattern: str, regex: bool = False, case_sensitive: bool = False, file_pattern: str | None = None, limit: int = 50, context: int = 0, max_per_file: int | None = None) -> dict[str, DataFrame]:
        """A scan with what its numbers are of: the hits, the lines around them, and files and lines scanned and hit."""
        files = self._scanned_files(corpus, file_pattern)
        wanted = self._pattern(pattern, regex, case_sensitive)
        hits = reads.grep(files, wanted, max_per_file or limit, limit)
        return {"hits": hits, "lines": reads.context_lines(files, hits, max(0, min(context, reads.CONTEXT_MOST))).orderBy("file", "line"), "totals": reads.grep_totals(files, wanted)}

    def grep_bounded(self, corpus: str, pattern: str, seconds: float = scans.BUDGET, case_sensitive: bool = False, file_pattern: str | None = None, limit: int = 50, max_per_file: int | None = None) -> tuple[str, dict[str, int], DataFrame]:
        """A scan for a pattern with a budget of time: status, totals of what was scanned, and the first lines."""
        return scans.scan_lines(self._scanned_files(corpus, file_pattern), pattern, not case_sensitive, seconds, max_per_file or limit, limit)

    def _scanned_files(self, corpus: str, file_pattern: str | None) -> DataFrame:
        files = self.table("files", corpus).withColumnRenamed("relpath", "file")
        files = files.filter(search.like(F.col("file"), file_pattern)) if file_pattern else files
        return files.filter(~reads.is_derived(F.col("file"), file_pattern)).select("file", "text")

    @staticmethod
    def _pattern(pattern: str, regex: bool, case_sensitive: bool) -> str:
        return ("(?m)" if case_sensitive else "(?mi)") + pattern if regex else reads.literal(pattern, not case_sensitive)

    def grep_totals(self, corpus: str, pattern: str, regex: bool = False) -> DataFrame:
        files = self.table("files", corpus).withColumnRenamed("relpath", "file")
        return reads.grep_totals(files, "(?mi)" + pattern if regex else reads.literal(pattern))

    # threads and citations

    def _edges(self, corpus: str) -> DataFrame:
        return self.table("messages", corpus).filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("parent"), F.col("message_id").alias("child"))

    def find_replies(self, corpus: str, message_id: str, max_messages: int = 20) -> DataFrame:
        root = self.spark.createDataFrame([(message_id,)], "node string")
        below = threads.descendants(self._edges(corpus), root).select(F.col("node").alias("message_id"), "depth")
        return self.table("messages", corpus).join(below, "message_id").orderBy("date", "message_id").limit(max_messages)

    def read_topic(self, corpus: str, query: str, limit: int = 20, include_replies: bool = False, body_chars: int | None = None, **facets) -> DataFrame:
        """Messages nearest the query in the order of time, with the newest of their replies; texts are cut to `body_chars`."""
        most = max(BODY_LEAST, min(body_chars, BODY_MOST)) if body_chars and body_chars > 0 else BODY_CHARS
        found = self.search_corpus(corpus, query, limit=max(3 * limit, 60), diversify=False, snippet=False, sort="date", **facets)
        kind = F.element_at(F.split("file", "/"), 1)
        found = found.filter(kind.isin("threads", "issues")).orderBy(F.desc("chunk_date"), "file", "chunk_idx").limit(limit)
        texts = found.select(F.col("url").alias("id"), F.col("text").alias("_text"))
        matched = found.select(F.col("url").alias("id"), F.col("chunk_date").alias("when"))
        if not include_replies:
            out = matched.withColumn("matched", F.lit(True))
        else:
            m = self.table("messages", corpus)
            roots = matched.join(m, m["archived_at"] == matched["id"]).select(F.col("message_id").alias("node"))
            below = threads.descendants(self._edges(corpus), roots).select(F.col("node").alias("message_id")).distinct()
            replies = m.join(below, "message_id")
            texts = texts.unionByName(replies.select(F.col("archived_at").alias("id"), F.col("body").alias("_text")))
            out = threads.topic(matched, replies.select(F.col("archived_at").alias("id"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("when")))
        texts = texts.groupBy("id").agg(F.min("_text").alias("_text"))
        cut = F.length("_text") > most
        return out.join(texts, "id", "left").withColumn("body", F.when(cut, F.concat(F.substring("_text", 1, most), F.lit("…"))).otherwise(F.col("_text"))).drop("_text").orderBy("when", "id")

    def find_citations(self, corpus: str, draft: str) -> DataFrame:
        one = self.spark.createDataFrame([(draft,)], "d string").select(X.draft_name(F.col("d")).alias("name"))
        return threads.citations(self.table("messages", corpus).select(F.col("message_id").alias("id"), F.col("body").alias("text"))).join(F.broadcast(one), "name", "left_semi")

    def find_message_citations(self, corpus: str, message_id: str) -> DataFrame:
        m = self.table("messages", corpus)
        found = threads.links(m.select(F.col("message_id").alias("id"), threads.strip_quotes(F.col("body")).alias("text")))
        edges = threads.linked(found, m.select(F.col("message_id").alias("id"), F.col("archived_at").alias("url"))).select(F.col("id").alias("src"), F.col("target").alias("dst"), "url")
        return records.both_directions(edges, F.lit(message_id))

    def tally_positions(self, corpus: str, thread: str) -> dict[str, DataFrame]:
        """Summary (counts null where coverage is too low), positions by message, poll choices, last votes and chairs' declarations.

        In threads of issues and pull requests a number sign at the start of a line names an issue and is no vote.
        """
        m = self.table("messages", corpus).filter(F.col("thread") == thread)
        m = m.withColumn("idx", F.row_number().over(Window.orderBy("date", "message_id"))) if "idx" not in m.columns else m
        own = stances.classified(m.select("thread", "idx", "sender", "body"), bare_hash=not thread.startswith(("issues/", "pulls/")))
        out = {"summary": stances.tally(own), "positions": own.orderBy("idx"), "poll": stances.poll(own).orderBy("place"), "votes": stances.votes(own).orderBy("sender")}
        if "people" in self.tables and "role" in self.tables["people"].columns:
            roles = self.table("people", corpus).select(F.col("name").alias("sender"), "role")
            out["chairs"] = stances.chair_statements(m.select("thread", "idx", "sender", "body"), roles).orderBy("idx")
        return out

    # derived tables

    def read_digest(self, corpus: str, kind: str, limit: int = 100, sort: str | None = None, **filters) -> DataFrame:
        """Rows of a derived table that meet the filters, in the table's own order or (sort="activity") the busiest first; the limit holds a repository."""
        if kind not in DIGESTS:
            raise ValueError(f"kinds: {', '.join(DIGESTS)}")
        if unknown := set(filters) - set(DIGESTS[kind]):
            raise ValueError(f"{kind} cannot be filtered by {', '.join(sorted(unknown))}")
        if sort not in (None, "activity") or sort and kind not in ACTIVITY:
            raise ValueError(f"{kind} cannot be sorted by {sort}")
        if kind == "timeline":
            return digests.timeline_rows(self.table("timeline", corpus), limit=limit, **filters)
        rows = self.table("issues" if kind == "labels" else kind, corpus)
        if kind == "labels":
            return digests.labels(rows.select(F.explode("labels").alias("label"))).orderBy(F.desc("n"), "label")
        if kind in ("issues", "pulls"):
            rows = rows.withColumn("last", F.col("updated")).withColumn("label", F.array_join("labels", ","))
        rows = digests.matching(rows, **filters)
        order = [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDERS[kind] if c.lstrip("-") in rows.columns] or [F.asc(c) for c in rows.columns[:3]]
        if sort:
            order = [F.desc_nulls_last(ACTIVITY[kind]), *order]
        if kind in ("issues", "pulls"):
            return digests.sectioned(rows, "repo", order if sort else [F.desc(F.lower("state") == "open"), *order], limit)
        return rows.orderBy(*order).limit(limit)

    def people_note(self, corpus: str, limit: int = 100, org: str | None = None, domain: str | None = None) -> DataFrame:
        """What the numbers of a people table are of: total, matched, shown, and rows that can't match for want of a value."""
        rows = self.table("people", corpus).select(F.try_element_at("orgs", F.lit(1)).alias("org"), F.try_element_at("domains", F.lit(1)).alias("domain"), "orgs", "domains")
        hit = F.lit(True)
        if org:
            hit = hit & F.coalesce(F.contains(F.lower("org"), F.lit(org.lower())), F.lit(False))
        if domain:
            hit = hit & F.coalesce(F.exists("domains", lambda d: X.domain_within(d, domain.lower().lstrip("@."))), F.lit(False))
        return digests.people_note(rows, hit, limit)

    def list_labels(self, corpus: str) -> DataFrame:
        tags = digests.subject_tags(self.table("messages", corpus)).select(F.col("tag").alias("label"), "n", F.lit("subject").alias("source"))
        return self.read_digest(corpus, "labels").select("label", "n", F.lit("issue").alias("source")).unionByName(tags)

    def overview(self, corpus: str) -> dict[str, DataFrame]:
        """Small tables, each of a bounded number of rows; those whose tables the store lacks are left out."""
        has = lambda *names: all(n in self.tables for n in names)
        out = {"active threads": digests.active_threads(self.table("threads", corpus)), "recent": digests.folded(self.table("timeline", corpus), 200)}
        if has("issues"):
            out["labels"] = self.read_digest(corpus, "labels").limit(20)
            if "title" in self.tables["issues"].columns:
                out["open issues"] = digests.recent_open(self.table("issues", corpus), 20)
        if has("topics"):
            out["themes"] = records.themes(self.table("topics", corpus))
        if has("drafts", "authorships", "citations"):
            d = self.table("drafts", corpus)
            gone = d.filter(F.col("state").isin(*chunking.CONCLUDED)) if "state" in d.columns else d.limit(0)
            summary = records.documents_summary(d.select(F.col("draft").alias("doc")).distinct(), self.table("authorships"), self.table("citations", corpus).select("name"), gone.select(F.col("draft").alias("doc")))
            out["documents"] = summary.orderBy(F.desc("active"), F.desc("citations"), "doc").limit(50)
        if has("positions"):
            out["unresolved"] = records.unresolved_discusses(self.table("positions")).limit(50)
        if has("milestones", "groups"):
            out["milestones"] = self.list_milestones(F.current_date()).limit(20)
        return out

    # groups, drafts, meetings, records

    def search_groups(self, query: str, limit: int = 15, **filters) -> DataFrame:
        """By charter vectors if there are any and one is near enough, else by words."""
        g = search.group_filter(self.table("groups"), **filters)
        if "charters" in self.tables and self.embed is not None:
            near = g.join(self._charters_near(query), "acronym")
            if not near.isEmpty():
                return near.orderBy(F.desc("score"), "acronym").limit(limit)
        q = query.lower()
        score = F.when(F.lower("acronym") == q, 100).otherwise(0) + 10 * search.occurrences(F.lower("name"), q) + search.occurrences(F.lower("description"), q)
        return g.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "acronym").limit(limit)

    def get_group_info(self, acronym: str, include_charter: bool = True) -> DataFrame:
        """The group's record, with the text of its newest charter where the store has one. charter_texts: acronym, rev, text."""
        row = self.table("groups").filter(F.col("acronym") == acronym)
        if not include_charter or "charter_texts" not in self.tables:
            return row
        newest = self.table("charter_texts").filter(F.col("acronym") == acronym).groupBy("acronym").agg(F.max("rev").alias("charter_rev"), F.max_by("text", "rev").alias("charter"))
        return row.join(newest, "acronym", "left")

    def list_milestones(self, today, **filters) -> DataFrame:
        return records.milestones(self.table("milestones"), self.table("groups"), (F.lit(today) if isinstance(today, str) else today).cast("date"), **filters)

    def group_timeline(self, acronym: str, year: int | None = None) -> DataFrame:
        rows = self.table("group_events").filter(F.col("acronym") == acronym)
        return (rows.filter(F.year("when") == year) if year else rows).orderBy("when", "kind", "title")

    def list_drafts(self, corpus: str, state: str | None = None) -> DataFrame:
        d = self.table("drafts", corpus)
        return (d.filter(F.col("state") == state) if state else d).orderBy("draft", "rev")

    def draft_status(self, name: str | None = None) -> DataFrame:
        """What documents are for an agenda; of one, whose name may carry a revision."""
        rows = self.table("draft_states")
        if name is not None:
            one = self.spark.createDataFrame([(name,)], "n string").select(X.draft_name(F.col("n")).alias("doc"))
            rows = rows.join(F.broadcast(one), "doc", "left_semi")
        return rows.withColumn("what", digests.agenda_eligibility())

    def list_meetings(self, corpus: str, kinds: tuple[str, ...] = ("minutes", "slides", "transcript", "polls")) -> DataFrame:
        return digests.artefacts(self.table("meeting_files", corpus), kinds).orderBy("meeting")

    def read_minutes(self, corpus: str, meeting: str | None = None) -> DataFrame:
        """Minutes of a meeting (the newest without one), with the polls of its sessions."""
        files = self.table("meeting_files", corpus)
        rows = files.filter("kind = 'minutes'")
        rows = rows.filter(F.col("meeting") == meeting) if meeting else rows.orderBy(F.desc("date"), "meeting").limit(1)
        return files.filter("kind IN ('minutes', 'polls')").join(rows.select("meeting").distinct(), "meeting", "left_semi").orderBy("meeting", "kind")

    def draft_authors(self, corpus: str, name: str) -> DataFrame:
        """Authors that the newest revision of a draft names in its addresses: place, name, editor, organisation, email, address."""
        newest = reads.newest_revision(self.table("drafts", corpus).filter(F.col("draft") == name)).select(F.col("path").alias("relpath"))
        text = self.table("files", corpus).join(F.broadcast(newest.limit(1)), "relpath", "left_semi")
        return text.select(F.posexplode(addresses(F.col("text"))).alias("_k", "a")).select((F.col("_k") + 1).alias("place"), "a.*")

    def document_authors(self, document: str) -> DataFrame:
        """Recorded authors of a document in their order, with the names of known persons."""
        rows = self.table("authorship").filter(F.col("document") == document)
        people = self.table("persons").select(F.col("uri").alias("person"), "name")
        return rows.join(people, "person", "left").orderBy("order")

    def get_reviews(self, document: str) -> dict[str, DataFrame]:
        """Review assignments, ballot positions, and whether either has looked at the current revision."""
        reviews, positions = self.table("reviews").filter(F.col("doc") == document), self.table("positions").filter(F.col("doc") == document)
        current = self.table("draft_states").filter(F.col("doc") == document).select("doc", "rev", F.lit(True).alias("reachable"))
        return {"reviews": reviews.orderBy("assigned_on"), "positions": positions.orderBy("balloter"), "examined": records.examined(reviews.select("doc", "rev", "done"), positions.select("doc", "rev", "pos"), current)}

    def upcoming_meetings(self, now) -> DataFrame:
        return records.upcoming(self.table("meetings"), F.lit(now).cast("timestamp"))

    def meeting_schedule(self, meeting: str | None = None) -> DataFrame:
        """Sessions with their times in UTC and lengths, of one meeting or of all. sessions: meeting, code, local, zone, duration."""
        rows = self.table("sessions")
        return digests.meeting_times(rows.filter(F.col("meeting") == meeting) if meeting else rows).orderBy("start", "code")

    def session_log(self, limit: int = 200, since=None) -> DataFrame:
        """The newest entries of the log, oldest first. log: when, ..."""
        rows = self.table("log")
        rows = rows.filter(F.col("when") >= F.lit(since)) if since is not None else rows
        return rows.orderBy(F.desc("when")).limit(limit).orderBy("when")

    def suggest_repos(self) -> DataFrame:
        return records.repositories(self.table("repos"))

    def search_rfc_index(self, query: str, limit: int = 50, **filters) -> DataFrame:
        return records.rfc_search(self.table("rfcs"), query, **filters).limit(limit)

    def get_rfc_info(self, name: str) -> dict[str, DataFrame]:
        rfcs, refs = self.table("rfcs"), self.table("rfc_refs")
        return {"record": rfcs.filter(F.col("name") == name), "inbound": records.inbound(refs, rfcs, name), "outbound": records.outbound(refs, name), "relations": records.relations(rfcs).filter(F.col("dst") == name)}
