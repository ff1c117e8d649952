"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents, in a shuffled order, form one stream of words that is cut into equal blocks. A van der
Corput sequence, mapped through the sources' cumulative weights, says which source fills each slot of the mix; the
r-th slot of a source takes its r-th block, going round again once the stream is used up. The slot that would go
beyond a source's target is cut there, so each source gives its rounded target exactly.

Only DataFrame functions are used. Ranks and running sums are taken in two levels (totals of buckets, then within
one bucket), so a source with any share of the rows never meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 4096
#: Rows of one bucket of documents, slots of one chunk, cells that the unit interval is cut into for the join.
BUCKET_ROWS, CHUNK_SLOTS, CELLS = 20_000, 16_384, 1024
#: Rows (about 60 bytes each) up to which the mix is broadcast to the texts.
BROADCAST_ROWS = 500_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row a source (null last): sid, source, n_docs, source_size, weight, target.

    The weights repeat along the sources in code point order. target = min(most * source_size, level * weight), with
    the level at which the targets add up to share * all words: what resharing every excess by weight ends in. The
    level needs a few sums over the sources, each one row.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    per = per.withColumn("sid", rank.cast("long"))
    per = written(per.withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int"))), "mix-sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    goal, level = min(share, most) * total, 0.0
    while True:
        frozen = F.col("weight") * level >= F.col("source_size") * most
        used, free = per.agg(F.sum(F.when(frozen, F.col("source_size") * most)), F.sum(F.when(~frozen, F.col("weight")))).first()
        now = (goal - (used or 0)) / free if free else level
        if now <= level or not free:
            break
        level = now
    return per.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(float(level))))


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """One row a slot that is used: sid, slot (place in the mix), pass, block, length (words it takes).

    Slot s stands at the point whose binary digits are those of s reversed. An interval of the unit line gets its
    share of the first M points but for 2 * (log2(M) / 3 + 1), so with that many slots more for each source none gets
    too few; those left over are dropped.
    """
    spark = sources.sparkSession
    s, t = F.col("source_size"), F.col("goal")
    need = F.when(s > 0, F.floor(t / s) * F.ceil(s / block_words) + F.ceil((t % s) / block_words)).otherwise(0).cast("long")
    plan = sources.withColumn("goal", F.round("target").cast("long")).withColumn("n_blocks", F.ceil(s / block_words).cast("long")).withColumn("need", need)
    slots, n = plan.agg(F.sum("need"), F.count_if(F.col("need") > 0)).first()
    slots = slots or 0
    spare = 2 * math.ceil(math.log2(slots + n * 200 + 2) / 3 + 1)
    points = slots + n * spare
    bits = max(1, math.ceil(math.log2(points + 1)))
    until = F.sum(F.col("need") + spare).over(Window.orderBy("sid"))
    plan = plan.filter("need > 0").withColumn("hi", until / F.lit(float(max(1, points)))).withColumn("lo", (until - F.col("need") - spare) / F.lit(float(max(1, points))))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))
    cut = plan.select("sid", "source_size", "goal", "n_blocks", "need", "lo", "hi", F.explode(cells).alias("cell"))
    mirrored = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("double") / F.lit(float(2**bits))
    at = spark.range(points).select(F.col("id").alias("slot"), mirrored.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    got = at.join(cut, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).drop("cell", "u", "lo", "hi")
    got = got.withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    before = got.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = before.select("sid", "chunk", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    got = got.withColumn("in_chunk", rank).join(before, ["sid", "chunk"]).withColumn("rank", F.col("in_chunk") + F.col("before")).filter("rank < need")
    turn, block = F.floor(F.col("rank") / F.col("n_blocks")), F.col("rank") % F.col("n_blocks")
    got = got.withColumn("pass", turn).withColumn("block", block)
    whole = F.least(F.lit(block_words).cast("long"), s - F.col("block") * block_words)
    left = t - F.col("pass") * s - F.col("block") * block_words
    return got.select("sid", "slot", "pass", "block", F.least(whole, left).cast("long").alias("length"), whole.cast("long").alias("whole"))


def shuffled_stream(sizes: DataFrame, n_docs: int) -> DataFrame:
    """`sizes` (sid, doc_id, size, ...) with start: the words before the document in its source's shuffled stream."""
    buckets = max(1, math.ceil(n_docs / BUCKET_ROWS))
    order = F.xxhash64(F.lit("mix"), "doc_id", "size")
    rows = sizes.withColumn("_h", order).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    total = rows.groupBy("sid", "_bucket").agg(F.sum("size").alias("_n"))
    total = total.select("sid", "_bucket", (F.sum("_n").over(Window.partitionBy("sid").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = F.sum("size").over(Window.partitionBy("sid", "_bucket").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_inside", inside - F.col("size")).join(total, ["sid", "_bucket"])
    return rows.withColumn("start", (F.col("_inside") + F.col("_before")).cast("long")).drop("_h", "_bucket", "_inside", "_before")


def spans(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The spans that the mix's slots take of the documents, the shuffled streams (sid, doc_id, size, start), and the sources by sid."""
    sizes = written(sizes.select("doc_id", "source", F.col("size").cast("long").alias("size")), "mix-sizes")
    sources = written(source_targets(sizes, weights, share, most), "mix-targets")
    key = sources.select("sid", F.col("source").alias("_source"), "source_size", "target")
    rows = sizes.join(key.select("sid", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    stream = written(shuffled_stream(rows, sizes.count()), "mix-streams")
    cut = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    pieces = stream.filter("size > 0").select("sid", "doc_id", "size", "start", F.explode(cut).alias("block"))
    base = F.col("block") * block_words
    low, high = F.greatest(F.col("start"), base), F.least(F.col("start") + F.col("size"), base + F.col("length"))
    got = pieces.join(schedule(sources, block_words), ["sid", "block"]).filter(low < high)
    got = got.select("slot", "sid", "pass", "block", (low - base).alias("place"), "doc_id", "size", "start", (low - F.col("start")).alias("first"), (high - low).alias("words"))
    return got, stream, key


def blocks(sizes: DataFrame, **how) -> DataFrame:
    """The mix in the order of its slots, as spans of documents.

    sizes: as in `mix`, which has the parameters too. Returns slot, source, pass, block, place, doc_id, size, start,
    first, words: slot `slot` takes block `block` of the source's shuffled stream, and from word `place` of the block
    on stand `words` words of the document, from its word `first` on (all from 0). start is the document's place in the
    stream and tells repeated rows apart. Slots that no source needs are left out; each other has block_words words,
    but for the last block of a stream and the slot in which a source's target is reached. Sorted by slot and place.
    """
    got, _, key = spans(sizes, **how)
    got = written(got, "mix-spans").join(key.select("sid", F.col("_source").alias("source")), "sid")
    return got.select("slot", "source", "pass", "block", "place", "doc_id", "size", "start", "first", "words").orderBy("slot", "place")


def mix(sizes: DataFrame, **how) -> DataFrame:
    """How many words the mix takes of each document: the sums of the spans of `blocks`.

    sizes: doc_id, source, size (words, not null); other columns are dropped. how: weights (3, 1, 2), share 1.5, most 2
    and block_words 4096. Returns doc_id, source, size, source_size, target, taken, one row an input row. A document is
    taken whole in each pass over its source, but for the block in which the source's target is reached: there a
    leading part of it. So taken <= most * size.

    Null ids and sources are values like others (sources: last). Repeated rows are documents of their own. A size of
    0 gives taken 0; an empty table gives an empty result. The order depends on doc_id and size only: reruns agree.
    """
    got, stream, key = spans(sizes, **how)
    taken = got.groupBy("sid", "start").agg(F.sum("words").alias("_taken"))
    filled = F.when(F.col("size") > 0, F.col("_taken"))
    out = stream.join(taken, ["sid", "start"], "left").withColumn("taken", F.coalesce(filled, F.lit(0)).cast("long")).join(key, "sid")
    return out.select("doc_id", F.col("_source").alias("source"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """`docs` (doc_id, text, source, ...) in the order of the mix: a row for each time a document is taken, the last one cut to the words taken.

    A row stands at the slot of `blocks` that holds its first word. It isn't cut where its words run on into other
    slots. A cut text ends after its last word taken and keeps its white space up to there. Null and empty texts have no
    words and go; very long ones are like others. An empty table gives an empty result. Rows with the same doc_id, source and size are told apart by number. Documents of which nothing is taken
    go, also those without words.
    """
    cols = docs.columns
    docs = docs.withColumn("__mix_size", word_count(F.col("text")))
    sizes = written(docs.select("doc_id", "source", F.col("__mix_size").alias("size")), "mix-words")
    most = sizes.filter("size > 0").groupBy("doc_id", "source", "size").count().agg(F.max("count")).first()[0]
    got, _, key = spans(sizes, **how)
    got = got.groupBy("sid", "doc_id", "size", "start", "pass").agg(F.sum("words").cast("int").alias("__mix_words"), F.min(F.struct("block", "slot", "place")).alias("_at"))
    if (most or 1) > 1:
        docs = docs.withColumn("__mix_n", F.row_number().over(Window.partitionBy("doc_id", "source", "__mix_size").orderBy(F.xxhash64("text"))))
        got = got.withColumn("__mix_m", F.dense_rank().over(Window.partitionBy("sid", "doc_id", "size").orderBy("start")))
    else:
        docs, got = docs.withColumn("__mix_n", F.lit(1)), got.withColumn("__mix_m", F.lit(1))
    got = got.join(key, "sid").select(F.col("doc_id").alias("__mix_id"), F.col("_source").alias("__mix_source"), F.col("size").alias("__mix_got"), "__mix_m", "__mix_words", F.col("_at.slot").alias("__mix_slot"), F.col("_at.place").alias("__mix_place"))
    got = written(got, "mix-taken")
    got = F.broadcast(got) if got.count() <= BROADCAST_ROWS else got
    match = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_size") == F.col("__mix_got")) & (F.col("__mix_n") == F.col("__mix_m"))
    rows = docs.join(got, match).orderBy("__mix_slot", "__mix_place")
    few = F.greatest(F.col("__mix_words"), F.lit(1))
    words, gaps = (F.slice(x, F.lit(1), few) for x in (F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.split("text", WORD)))
    lead = F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, w)), "")
    return rows.withColumn("text", F.when(F.col("__mix_words") < F.col("__mix_size"), lead).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(*cols)
