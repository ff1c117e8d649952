"""Ranking and retrieval over chunk vectors (Q1 to Q39). Every order is total, so results don't depend on the plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import dot, mean_vectors, normalised
from skein.operators import kmeans
from skein.operators.ranks import placed
from skein.scratch import written

#: Fixed values of the ranking: balance of relevance and novelty, its pool, probed lists, fusion constant, floors.
MMR_LAMBDA, MMR_POOL, PROBES, RRF_K = 0.7, 50, 20, 60
ROUTE_FLOOR, CHARTER_FLOOR, CHARTER_WINDOW = 0.30, 0.62, 0.10
GENERIC_SHARE, GENERIC_COSINE, GENERIC_LEAST = 0.6, 0.5, 5
TOP_SECTIONS, TITLE_WEIGHT, CITATION_WEIGHT = 3, 0.10, 0.02
RESULTS_LEAST, RESULTS_MOST, CORPORA_MOST = 1, 100, 12


def like(column: Column, pattern: str) -> Column:
    """LIKE without regard to the case of ASCII letters and without an escape character."""
    lower = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = pattern.translate({c: c + 32 for c in range(65, 91)}).replace("\\", "\\\\")
    return lower.like(low)


def facets(df: DataFrame, file_pattern: str | None = None, since: str | None = None, until: str | None = None, label: str | None = None, state: str | None = None, author: str | None = None, role: str | None = None, dated: bool = False) -> DataFrame:
    """Q1: rows without a value on a filtered axis go. Dates are compared as text, so `until` excludes its own day."""
    if file_pattern is not None:
        df = df.filter(like(F.col("file"), file_pattern))
    if since is not None:
        df = df.filter(F.col("chunk_date") >= since)
    if until is not None:
        df = df.filter(F.col("chunk_date") <= until)
    if label is not None:
        df = df.filter(like(F.col("labels"), f"%{label}%"))
    if state is not None:
        df = df.filter(F.col("state") == state)
    for needle in (author, role):
        if needle is not None:
            df = df.filter(like(F.col("title"), f"%{needle}%"))
    return df.filter(F.col("chunk_date").isNotNull()) if dated else df


def scan(df: DataFrame, query: DataFrame, vector: str = "embedding") -> DataFrame:
    """Q2: score = cosine of unit vectors. query: one row, column `_q`."""
    return df.crossJoin(F.broadcast(query.limit(1))).withColumn("score", dot(F.col(vector), F.col("_q"))).drop("_q")


def collapsed(df: DataFrame, keys: tuple[str, ...] = ("file", "chunk_idx")) -> DataFrame:
    """Q4: the best fragment of each chunk, the first one of equals."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "sub_idx"))
    return df.withColumn("_n", first).filter("_n = 1").drop("_n")


def top(df: DataFrame, k: int, *ties: str) -> DataFrame:
    """The first k; what a caller may ask for at most is the facade's matter (`clamped`)."""
    return df.orderBy(F.desc("score"), *(ties or ("file", "chunk_idx"))).limit(k)


def clamped(limit: int) -> int:
    return min(RESULTS_MOST, max(RESULTS_LEAST, limit))


def over_fetch(limit: int) -> int:
    """Q14: hits to fetch where some will be thinned out, so that `limit` are left."""
    return max(4 * limit, 20)


def best_hits(ranked: DataFrame, n: int, vectors: DataFrame | None = None, by_corpus: bool = False) -> DataFrame:
    """Q3, Q5, Q10: corpus, file, chunk_idx, score and place of the first n hits (of each corpus, or of all).

    ranked: corpus, file, chunk_idx, sub_idx, score; vectors: the same keys and embedding. With vectors, a pool of the best
    hits is chosen from by relevance and novelty, and what n wants beyond it follows by relevance. Only the pool's vectors are
    fetched; a pool that lacks one stays in its order.
    """
    key = ["corpus", "file", "chunk_idx"]
    order = [F.desc("score"), *key]
    if by_corpus:
        rows = ranked.withColumn("place", F.row_number().over(Window.partitionBy("corpus").orderBy(*order))).filter(F.col("place") <= n)
    else:
        rows = top(ranked, n, *key).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    if vectors is None:
        return rows.select(*key, "score", "place")
    rows = written(rows.select(*key, "sub_idx", "score", "place"), "hits")
    ident = F.to_json(F.struct(*key)).alias("id")
    pool = rows.filter(F.col("place") <= MMR_POOL).select((F.col("corpus") if by_corpus else F.lit("")).alias("group"), ident, "score", "place")
    wanted = F.broadcast(rows.filter(F.col("place") <= MMR_POOL).select(*key, "sub_idx"))
    whole, rest = with_vectors(pool, vectors.join(wanted, [*key, "sub_idx"], "left_semi").select(ident, "embedding"))
    kinds = ", ".join(f"{c} {t}" for c, t in ranked.select(*key).dtypes)
    chosen = mmr(whole.drop("place"), n, group="group").select("id", "score", "place").unionByName(rest.select("id", "score", F.col("place").cast("int").alias("place")))
    return chosen.select(F.from_json("id", kinds).alias("k"), "score", "place").select("k.*", "score", "place").unionByName(rows.filter(F.col("place") > MMR_POOL).select(*key, "score", "place"))


def probed(df: DataFrame, centroids: DataFrame, query: DataFrame, probes: int = PROBES, filtered: bool = False) -> DataFrame:
    """Q8: rows of the nearest lists; everything when a facet is set. centroids: cluster_id, embedding."""
    if filtered:
        return df
    near = scan(centroids, query).orderBy(F.desc("score"), "cluster_id").limit(max(1, probes))
    # a condition on this side lets Spark prune the folders of a store that is laid out by list
    near = near.filter(F.col("score") >= -float("inf")).select("cluster_id")
    return df.join(F.broadcast(near), "cluster_id", "left_semi")


def related(df: DataFrame, seed: Column) -> DataFrame:
    """Q7: the query is the mean of the seed chunk's fragments, and the seed's chunk is left out."""
    own = df.filter(seed)
    query = mean_vectors(own, []).select(normalised(F.col("mean")).alias("_q"))
    rest = df.join(own.select("file", "chunk_idx").distinct(), ["file", "chunk_idx"], "left_anti")
    return scan(rest, query)


def mmr(pool: DataFrame, k: int, group: str = "query", lam: float = MMR_LAMBDA) -> DataFrame:
    """Q5: greedy choice by relevance less similarity to what is chosen; pool: group, id, score, embedding (at most MMR_POOL rows a group)."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "id"))
    pool = pool.withColumn("_n", best).filter(F.col("_n") <= MMR_POOL).drop("_n")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        v, score = np.stack([np.asarray(x, float) for x in pdf["embedding"]]), pdf["score"].to_numpy()
        chosen, nearest, left = [], np.full(len(pdf), -np.inf), np.ones(len(pdf), bool)
        while len(chosen) < min(k, len(pdf)):
            value = score if not chosen else lam * score - (1 - lam) * nearest
            at = int(np.argmax(np.where(left, value, -np.inf)))
            chosen.append(at)
            left[at] = False
            nearest = np.maximum(nearest, v @ v[at])
        out = pdf.loc[chosen, [group, "id", "score"]]
        out["place"] = np.arange(1, len(out) + 1, dtype="int32")
        return out

    kinds = dict(pool.dtypes)
    return pool.groupBy(group).applyInPandas(choose, f"{group} {kinds[group]}, id {kinds['id']}, score double, place int")


def with_vectors(pool: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q10: vectors fetched for a pool (group, id, score): the groups that have one for every row, to be diversified, and all others as they are."""
    got = pool.join(vectors.select("id", "embedding"), "id", "left")
    whole = got.groupBy("group").agg(F.bool_and(F.col("embedding").isNotNull()).alias("_whole"))
    got = got.join(whole, "group")
    return got.filter("_whole").drop("_whole"), got.filter("NOT _whole").drop("_whole", "embedding")


def probe_count(meta: dict[str, str], default: int = 20) -> int:
    """Q9: lists to probe: what the index's own metadata says, at least 1."""
    text = str(meta.get("nprobe", "")).strip()
    return max(1, int(text)) if text.lstrip("-").isdigit() else default


def by_file(hits: DataFrame) -> DataFrame:
    """Q16: the best hit of each file and the number of hits; order: best score, hits, file."""
    got = hits.groupBy("file").agg(F.max_by("chunk_idx", F.struct("score", -F.col("chunk_idx"))).alias("chunk_idx"), F.max("score").alias("score"), F.count("*").alias("hits"))
    return got.orderBy(F.desc("score"), F.desc("hits"), "file")


DRAFT = r"^drafts/(draft-.*?)-(\d{2})(?:\.txt)?$"


def newest_revisions(hits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Q17: of each draft (and values of the keys) only the newest matching revision; other files pass."""
    cols = hits.columns
    rows = hits.withColumn("_stem", F.regexp_extract("file", DRAFT, 1)).withColumn("_rev", F.regexp_extract("file", DRAFT, 2))
    drafts = rows.filter("_stem <> ''")
    newest = drafts.groupBy(*keys, "_stem").agg(F.max("_rev").alias("_rev"))
    return rows.filter("_stem = ''").select(*cols).unionByName(drafts.join(newest, [*keys, "_stem", "_rev"], "left_semi").select(*cols))


def merged_corpora(hits: DataFrame, k: int) -> DataFrame:
    """Q18: per-corpus top k, by score within one model, models interleaved by rank, in the order in which they first come.

    hits: corpus, model, score, id, and place (of the corpus among those asked for).
    """
    own = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("score"), "id"))
    best = hits.withColumn("_own", own).filter(F.col("_own") <= k).drop("_own")
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "corpus", "id"))
    models = best.groupBy("model").agg(F.min("place").alias("_seen"))
    return best.join(models, "model").withColumn("rank", rank).orderBy("rank", "_seen", "model").limit(k).drop("_seen")


def title_overlap(query: str, title: Column) -> Column:
    """Q22: share of the query's words of three letters or more that occur in the title."""
    words = [w for w in query.lower().split() if len(w) >= 3]
    if not words:
        return F.lit(0.0)
    return sum((F.lower(title).contains(w).cast("double") for w in words), F.lit(0.0)) / len(words)


def documents_ranked(hits: DataFrame, overlap: Column) -> DataFrame:
    """Q21: hits: doc, score, title, citations. The divisor stays 3 with fewer hits."""
    n = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score")))
    best = hits.withColumn("_n", n).filter(F.col("_n") <= TOP_SECTIONS)
    got = best.groupBy("doc").agg(F.sum("score").alias("_s"), F.first("title").alias("title"), F.first("citations").alias("citations"))
    score = F.col("_s") / TOP_SECTIONS + TITLE_WEIGHT * overlap + CITATION_WEIGHT * F.log1p("citations")
    return got.select("doc", score.alias("score")).orderBy(F.desc("score"), "doc")


#: Chunks fetched, documents and sections shown at most, and characters of a section and of all of them.
RETRIEVED, DOCUMENTS_MOST, SECTIONS_MOST, SECTION_CHARS, REPLY_CHARS = 200, 50, 10, 320, 40_000


def shown_sections(hits: DataFrame, documents: DataFrame, most: int = TOP_SECTIONS, chars: int = SECTION_CHARS, budget: int = REPLY_CHARS) -> DataFrame:
    """Q23: the best hit of each document's first sections, in the documents' order; `shown` until the budget of characters is used up.

    hits: doc, section (may be missing), chunk_idx, score, title, text, of at most RETRIEVED rows; documents: doc, score.
    The first section is always shown; once one does not fit, none after it is.
    """
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc"))
    order = documents.select("doc", rank.alias("rank"))
    rows = hits.withColumn("section", F.col("section") if "section" in hits.columns else F.lit(None).cast("string")).join(F.broadcast(order), "doc")
    best = F.row_number().over(Window.partitionBy("doc", "section").orderBy(F.desc("score"), "chunk_idx"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "chunk_idx"))
    rows = rows.withColumn("_b", best).filter("_b = 1").withColumn("place", place).filter(F.col("place") <= max(1, min(SECTIONS_MOST, most)))
    rows = rows.withColumn("text", F.substring(F.regexp_replace(F.regexp_replace("text", r"\s+", " "), "^ ", ""), 1, chars))
    used = F.sum(F.length("text") + F.length(F.coalesce("title", F.lit("")))).over(Window.orderBy("rank", "place"))
    out = rows.withColumn("shown", (used <= budget) | ((F.col("rank") == 1) & (F.col("place") == 1)))
    return out.select("rank", "place", "doc", "section", "title", "chunk_idx", "score", "text", "shown").orderBy("rank", "place")


#: A concluded group's factor, and what a query that is a group's acronym adds.
CLOSED_FACTOR, PINNED = 0.6, 1.0


def fused(lists: list[DataFrame], closed: Column | None = None, pinned: Column | None = None, most: int | None = None) -> DataFrame:
    """Q27: reciprocal ranks from 0 on, summed; closed ones weigh less, and a pinned one comes first. lists: id, score. closed and pinned: conditions on `id`. most: rows that count of each list (all)."""
    ranked = [placed(x.select("id", "score"), [], [F.desc("score"), F.asc_nulls_last("id")], "_rank") for x in lists]
    ranked = [(x.filter(F.col("_rank") <= most) if most is not None else x).select("id", (1.0 / (RRF_K + F.col("_rank") - 1)).alias("part")) for x in ranked]
    union = ranked[0]
    for x in ranked[1:]:
        union = union.unionByName(x)
    score = F.col("score") * (F.when(closed, CLOSED_FACTOR).otherwise(1.0) if closed is not None else 1.0)
    score = score + (F.when(pinned, PINNED).otherwise(0.0) if pinned is not None else 0.0)
    return union.groupBy("id").agg(F.sum("part").alias("score")).withColumn("score", score)


def recentred(centroids: DataFrame, query: DataFrame) -> DataFrame:
    """Q31: mean-centred cosine of every centroid. centroids: corpus, id, embedding; query: one row `_q`."""
    mean = mean_vectors(centroids, [], out="_mean")
    rows = centroids.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(query.limit(1)))
    less = lambda a: normalised(F.zip_with(a, F.col("_mean"), lambda x, m: x - m))
    return rows.withColumn("score", dot(less(F.col("embedding")), less(F.col("_q")))).drop("_q", "_mean")


def routed(centroids: DataFrame, query: DataFrame, floor: float = ROUTE_FLOOR) -> DataFrame:
    """Q30: best centroid of each corpus; `confident` is false for all if the best is below the floor."""
    best = recentred(centroids, query).groupBy("corpus").agg(F.max("score").alias("score"))
    return best.withColumn("confident", F.max("score").over(Window.partitionBy()) >= floor)


#: Themes of a block, and blocks whose centres go to every task at most.
THEME_BLOCK, THEME_BLOCKS, THEME_SEED = 2000, 1 << 14, 1729


def theme_blocks(unit: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of near themes, and the pairs of blocks (a <= b) that may hold themes as near as GENERIC_COSINE.

    unit: corpus, theme, v (of length 1). Themes are clustered; a cluster of more than `rows` is dealt to several blocks. Two blocks can be skipped if the angle between their centres less both radii is too wide.
    """
    import numpy as np
    import pyarrow as pa

    wanted = max(1, min(THEME_BLOCKS, -(-unit.count() // rows)))
    if wanted > 1:
        own = unit.select(F.lit(0).alias("corpus"), F.struct("corpus", "theme").alias("id"), F.col("v").alias("embedding"))
        found = kmeans.clustered(own, F.lit(wanted), THEME_SEED).select("id.corpus", "id.theme", F.col("cluster").alias("pivot"))
        dealt = written(unit.join(found, ["corpus", "theme"]), "theme-clusters")
    else:
        dealt = unit.withColumn("pivot", F.lit(0))
    sizes = dealt.groupBy("pivot").agg(F.ceil(F.count("*") / rows).alias("_parts"))
    part = F.pmod(F.xxhash64("corpus", "theme"), F.col("_parts"))
    own = written(dealt.join(sizes, "pivot").select("corpus", "theme", "v", F.xxhash64("pivot", part).alias("block")), "theme-blocks")
    centres = mean_vectors(own, ["block"], "v").select("block", normalised(F.col("mean")).alias("c"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("v"), F.col("c"))))
    wide = written(own.join(centres, "block").groupBy("block").agg(F.first("c").alias("c"), F.max(F.acos(cosine)).alias("radius")), "theme-centres")
    held = wide.orderBy("block").toArrow()
    blocks, centre, radius = held["block"].to_numpy(), np.array(held["c"].to_pylist()).reshape(len(held), -1), held["radius"].to_numpy()
    known = unit.sparkSession.sparkContext.broadcast((blocks, centre, radius))

    def near(batches):
        blocks, centre, radius = known.value
        for batch in batches:
            for block, c, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                angle = np.arccos(np.clip(centre @ np.array(c), -1, 1)) - radius - r
                b = blocks[(angle <= np.arccos(GENERIC_COSINE) + 1e-6) & (blocks >= block)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), block)), pa.array(b)], names=["a", "b"])

    return own, wide.select("block", "c", "radius").mapInArrow(near, "a long, b long")


def generic_themes(themes: DataFrame, block: int = THEME_BLOCK) -> DataFrame:
    """Q33: themes near a theme of most other corpora. themes: corpus, theme, embedding (of equal lengths).

    Themes lie in blocks of near ones; pairs of blocks that are too far apart are skipped, each other pair is one product
    of matrices in one task. Only hits leave a task; misses are what is left of the number of corpora.
    """
    mean = mean_vectors(themes, [], out="_mean")
    unit = written(themes.crossJoin(F.broadcast(mean)).select("corpus", "theme", normalised(F.zip_with("embedding", "_mean", lambda x, m: x - m)).alias("v")), "themes")
    others = unit.select("corpus").distinct().count() - 1
    own, pairs = theme_blocks(unit, block)
    pairs = written(pairs, "theme-pairs")
    left = own.withColumnRenamed("block", "a").join(pairs, "a").select("a", "b", "corpus", "theme", "v")
    right = own.select(F.col("block").alias("d"), F.col("corpus").alias("other"), F.col("theme").alias("near"), F.col("v").alias("w")).join(pairs.select(F.col("a").alias("c"), F.col("b").alias("d")), "d").select("c", "d", "other", "near", "w")

    def hits(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(x) or not len(y):
            return pd.DataFrame({"corpus": [], "theme": [], "other": []})
        i, j = np.nonzero(np.stack(x["v"]) @ np.stack(y["w"]).T >= GENERIC_COSINE)
        one = pd.DataFrame({"corpus": x["corpus"].to_numpy()[i], "theme": x["theme"].to_numpy()[i], "other": y["other"].to_numpy()[j]})
        two = pd.DataFrame({"corpus": y["other"].to_numpy()[j], "theme": y["near"].to_numpy()[j], "other": x["corpus"].to_numpy()[i]})
        both = pd.concat([one, two]).drop_duplicates()
        return both[both["corpus"] != both["other"]]

    kind = dict(themes.dtypes)
    found = left.groupBy("a", "b").cogroup(right.groupBy("c", "d")).applyInPandas(hits, f"corpus {kind['corpus']}, theme {kind['theme']}, other {kind['corpus']}")
    count = found.distinct().groupBy("corpus", "theme").agg(F.count("*").alias("_hits"))
    share = F.coalesce("_hits", F.lit(0)) / max(others, 1)
    out = unit.select("corpus", "theme").join(count, ["corpus", "theme"], "left").withColumn("share", share)
    return out.drop("_hits").withColumn("generic", (F.col("share") >= GENERIC_SHARE) & F.lit(others + 1 >= GENERIC_LEAST)).filter(F.lit(others > 0))


def clean_word(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum())


def term_score(acronym: Column, name: Column, about: Column, term: str) -> Column:
    """Q25: acronym 100 or its beginning 40; else the beginning of a word of the name 10 and a place in the text 1."""
    exact = F.when(F.lower(acronym) == term, 100).when(F.lower(acronym).startswith(term), 40)
    if len(term) < 3:
        return F.coalesce(exact, F.lit(0))
    in_name = F.exists(F.split(F.lower(name), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "").startswith(term))
    return F.coalesce(exact, F.when(in_name, 10).otherwise(0) + F.when(F.lower(about).contains(term), 1).otherwise(0))


def occurrences(text: Column, term: str) -> Column:
    """Q28: places of a term, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def all_terms_prefix(df: DataFrame, terms: list[str], words: Column) -> DataFrame:
    """Q35: every term begins one of the words."""
    begins = lambda t: F.exists(words, lambda w: w.startswith(t))
    for t in terms:
        df = df.filter(begins(t))
    return df


CLOSED_STATES = ("conclude", "concluded", "abandon", "replaced", "dormant")


def group_filter(df: DataFrame, state: str | None = None, area: str | None = None, kind: str | None = None) -> DataFrame:
    """Q38: `closed` is a class of states; an area goes by acronym or name."""
    if state == "closed":
        df = df.filter(F.col("state").isin(*CLOSED_STATES))
    elif state:
        df = df.filter(F.col("state") == state)
    if area:
        df = df.filter((F.lower("area") == area.lower()) | (F.lower("area_name") == area.lower()))
    return df.filter(F.col("kind") == kind) if kind else df


def empty_reasons(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """Q39: rows that each filter alone would keep, so an empty result can name the one that excludes everything."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(name) for name, c in filters.items()))


#: What a hit has, whatever table it comes from.
HIT = {
    "corpus": "string", "file": "string", "chunk_idx": "int", "title": "string", "text": "string", "score": "double", "url": "string", "chunk_date": "string",
    "labels": "string", "state": "string", "duplicate_of": "long", "rationale": "string", "start_line": "int", "end_line": "int",
}


def as_hits(rows: DataFrame, rationale_chars: int = 400) -> DataFrame:
    """Q12, Q20: rows as hits: the columns of HIT, null where a table has none, and the closing rationale on one line, cut to a length."""
    cols = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in HIT.items()]
    flat = F.regexp_replace(F.regexp_replace("rationale", r"\s+", " "), r"^ | $", "")
    cut = F.when(F.length(flat) > rationale_chars, F.concat(F.substring(flat, 1, rationale_chars - 1), F.lit("…"))).otherwise(flat)
    return rows.select(*cols).withColumn("rationale", cut)
