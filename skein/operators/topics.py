"""Topics: clustering, labels, exemplars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import dot
from skein.operators import kmeans
from skein.scratch import written

#: Least and most clusters, seed, terms, exemplars, least documents of a map.
K_LEAST, K_MOST, SEED, TERMS, EXEMPLARS, LEAST_DOCS = 4, 32, 1729, 6, 3, 8


def choose_k(n: Column) -> Column:
    """K1: the square root of half the documents, rounded to even, within bounds; as many as documents up to four."""
    return F.when(n <= K_LEAST, n).otherwise(F.greatest(F.lit(K_LEAST), F.least(F.lit(K_MOST), F.bround(F.sqrt(n / 2))))).cast("int")


#: Words that say nothing of a topic, and the form of one that may.
STOPWORDS = """
    the and for that this with you your are not but they have has had was were
    will would should could can may might must from out who whom which what when
    where why how all any some such only also then than them their there these
    those been being does did done into onto over under more most much many one
    two get got see use used using like just well good make made does don doesn
    isn aren wasn weren about above below after before again here once each other
    draft drafts ietf wg working group mailing list email mail message thread
    issue issues github comment comments subject sent wrote writes regards thanks
    hello hi re fwd cheers best please think
""".split()
TERM = r"[a-z][a-z0-9][a-z0-9-]+"


def terms(text: Column) -> Column:
    """K6: the words of a text that may label a topic, in order, repeats kept."""
    stop = F.array(*[F.lit(w) for w in sorted(set(STOPWORDS))])
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda w: ~F.array_contains(stop, w))


#: Bytes of text that a task splits into words at once, each of which takes several times its size.
SLICE_BYTES = 1 << 22


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of at most so many bytes of text or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, until - at)
        at = until


def term_totals(docs: DataFrame) -> DataFrame:
    """cluster, term, tf (occurrences), docs (documents that have it). docs: cluster, text, a row a document.

    A batch of documents is counted where it is read, in slices of SLICE_BYTES of text (a longer text is one by itself), which
    bound the memory of a task. A slice gives a row for each cluster and term it holds; so no row is made for a word, and none
    for a document's terms.
    """
    kind = dict(docs.dtypes)["cluster"]
    stop, most = pa.array(sorted(set(STOPWORDS))), SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, 2, most)):
            lists = pc.split_pattern_regex(batch.column(2), "[^a-z0-9-]+")
            words, sizes = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            # a word has one term at most: from the first place where one can begin to its end
            found = pc.struct_field(pc.extract_regex(words.dictionary, f"(?P<term>{TERM})"), "term")
            found = pc.if_else(pc.is_in(found, stop), None, found).dictionary_encode()
            term = found.indices.fill_null(-1).to_numpy(zero_copy_only=False)[words.indices.to_numpy()]
            doc = np.repeat(np.arange(len(batch)), sizes.astype(np.int64))
            doc, term = doc[term >= 0], term[term >= 0].astype(np.int64)
            names = batch.column(1).dictionary_encode().indices.to_numpy()
            width = max(1, len(found.dictionary))
            pair, tf = np.unique(names[doc] * width + term, return_counts=True)
            once = np.unique(doc * width + term)
            docs_ = np.unique(names[once // width] * width + once % width, return_counts=True)[1]
            first = np.unique(names, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first[pair // width])), found.dictionary.take(pa.array(pair % width)), pa.array(tf), pa.array(docs_)], names=["cluster", "term", "tf", "docs"])

    rows = docs.select("cluster", F.to_json(F.struct("cluster")).alias("name"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    if rows.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism:  # one small file would be one task
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    parts = rows.mapInArrow(run, f"cluster {kind}, term string, tf long, docs long")
    return parts.groupBy("cluster", "term").agg(F.sum("tf").alias("tf"), F.sum("docs").alias("docs"))


def cluster_labels(totals: DataFrame, docs: DataFrame, terms: int = TERMS) -> DataFrame:
    """K5: terms of the highest tf * ln(N / df) in each cluster, ties by term; a term in all documents says nothing.

    totals: as of `term_totals`. A document is in one cluster, so the clusters' document counts of a term add up to df.
    """
    totals = written(totals, "term-totals")
    df = totals.groupBy("term").agg(F.sum("docs").alias("df"))
    n = docs.agg(F.count("*").alias("_n"))
    rows = totals.join(df, "term").crossJoin(F.broadcast(n)).filter("df < _n").withColumn("score", F.col("tf") * F.log(F.col("_n") / F.col("df")))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 9)), "term"))
    return rows.withColumn("place", place).filter(F.col("place") <= terms).select("cluster", "term", "place", "score")


def exemplars(rows: DataFrame, centroids: DataFrame, most: int = EXEMPLARS) -> DataFrame:
    """K7: distinct titles nearest the centroid. rows: cluster, title, embedding; centroids: cluster, mean."""
    near = rows.join(centroids, "cluster").groupBy("cluster", "title").agg(F.max(dot(F.col("embedding"), F.col("mean"))).alias("score"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "title"))
    return near.withColumn("place", place).filter(F.col("place") <= most)


#: Subjects of notices that machines write.
NOTICE = r"(?i)^\s*(?:i-d action|protocol action|document action|wg action|new version notification|publication has been requested|the ietf datatracker)\b"


def discussions(docs: DataFrame) -> DataFrame:
    """K8: documents that people wrote. docs: title, ..."""
    return docs.filter(~F.coalesce(F.col("title").rlike(NOTICE), F.lit(False)))


def topic_table(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """Corpus, cluster, size, terms, label, exemplars, last_active and centroid of each topic, for reading and for routing.

    clusters: corpus, id, cluster; docs: corpus, id, title, text, embedding, last_active (of `discussions`). They are joined once: what follows
    reads its own columns of the joined table.
    """
    from skein.functions.vectors import mean_vectors

    rows = written(docs.join(clusters, ["corpus", "id"]), "topic-documents")
    own = F.struct("corpus", "cluster").alias("cluster")
    text = rows.select(own, F.concat_ws(" ", "text", "title").alias("text"), "corpus")
    n = text.groupBy("corpus").agg(F.count("*").alias("_docs"))
    tf = written(term_totals(text.select("cluster", "text")), "term-totals").withColumn("corpus", F.col("cluster.corpus"))
    df = tf.groupBy("corpus", "term").agg(F.sum("docs").alias("df"))
    scored = tf.join(df, ["corpus", "term"]).join(n, "corpus").filter("df < _docs").withColumn("score", F.col("tf") * F.log(F.col("_docs") / F.col("df")))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 9)), "term"))
    best = scored.withColumn("_p", place).filter(F.col("_p") <= TERMS).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("_p", "term"))).alias("_t")).select("cluster", F.col("_t.term").alias("terms"))
    centre = mean_vectors(rows.select(own, "embedding"), ["cluster"])
    near = exemplars(rows.select(own, "title", "embedding"), centre).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("_e")).select("cluster", F.col("_e.title").alias("exemplars"))
    out = rows.groupBy(own).agg(F.count("*").alias("size"), F.max("last_active").alias("last_active")).join(best, "cluster", "left").join(near, "cluster", "left").join(centre.withColumnRenamed("mean", "centroid"), "cluster")
    return out.select("cluster.*", "size", "terms", F.array_join(F.slice("terms", 1, 3), ", ").alias("label"), "exemplars", "last_active", "centroid")


def clustered(rows: DataFrame) -> DataFrame:
    """K2 to K4, K8: corpus, id, cluster (numbered by size); a corpus of fewer than LEAST_DOCS has none. rows: corpus, id, embedding."""
    return kmeans.clustered(rows, choose_k(F.col("n")), SEED, LEAST_DOCS)
