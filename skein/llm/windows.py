"""Removes passages that stand in an earlier document too: all windows of some words, counted exactly.

Consecutive windows whose least word group (the minimiser, by hash) is the same are one string of their words, a
super-k-mer, and travel to the bucket of that minimiser; equal windows have equal minimisers, so each bucket can sort its
windows alone. A block of texts sends each bucket one compressed parcel of strings. A window that the same block holds in an
earlier document is settled there and doesn't travel, so a passage of a million copies is sent once a block. Minimisers
that would make a bucket large send their windows singly, dealt by the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drained, forget, written
from .words import BASE, Words, mixed, raw

WINDOW, GROUP = 13, 2
#: Texts of a block: their windows are compared at once. A longer text is a block alone.
BLOCK_BYTES = 8 << 20
#: Words a super-k-mer may have, so that one endless repetition isn't one row.
LONGEST = 2048
#: Windows of a bucket, about; one of over BUCKET_MOST times as many is sorted in parts.
BUCKET_WINDOWS, BUCKET_MOST = 1 << 18, 4
#: A cell (minimisers with the same leading bits) is large if it holds over LARGE windows, and over a HEAVIEST-th of all:
#: so at most HEAVIEST are, whatever the input. Cells for each partition of the input, and bits of their number at least.
LARGE, HEAVIEST, CELLS, CELL_BITS = 1 << 16, 1 << 20, 1 << 12, 17
#: Words that are joined to strings at once, so that a text of any length can be sent.
PACKED_WORDS = 1 << 24
CODEC, LEVEL = "zstd", 3


@dataclass
class Settings:
    size: int = WINDOW
    group: int = GROUP
    block: int = BLOCK_BYTES
    longest: int = LONGEST
    bucket: int = BUCKET_WINDOWS
    large: int = LARGE
    packed: int = PACKED_WORDS


@dataclass
class Block:
    """Words of some texts as numbers that are equal just where the words are (within this block)."""

    names: pa.Array  # the different words
    ids: np.ndarray
    doc: np.ndarray  # first word of each text and, last, their number

    @staticmethod
    def of(texts: pa.Array) -> Block:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        flat, at = lists.flatten(), np.asarray(lists.offsets, np.int64)
        at = at - at[0]
        coded = flat.dictionary_encode()
        ids, names = np.asarray(coded.indices, np.int32), coded.dictionary
        void = pc.index(names, "").as_py()
        if void >= 0:  # texts that begin or end with white space
            some = ids != void
            at = np.concatenate([[0], np.cumsum(some)])[at]
            ids = ids[some]
        return Block(names, ids, at)

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes, the same in every block."""
        body, at = raw(self.names)
        return Words(body, at[:-1], at[1:], np.array([0, len(self.names)])).hashes()[self.ids] if len(self.ids) else np.zeros(0, np.uint64)

    def starts(self, size: int) -> np.ndarray:
        """First words of all windows, text by text."""
        n = np.maximum(np.diff(self.doc) - size + 1, 0)
        first = np.concatenate([[0], np.cumsum(n)])
        return np.arange(first[-1]) + np.repeat(self.doc[:-1] - first[:-1], n)


def rolled(values: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A hash of the values start, start + 1, ... of each place."""
    out = np.zeros(len(start), np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(BASE) + values[start + k].astype(np.uint64))
    return out


def minimisers(h: np.ndarray, start: np.ndarray, size: int, group: int) -> np.ndarray:
    """The least hash of the word groups of each window. h: of each word."""
    if not len(start):
        return np.zeros(0, np.uint64)
    grams = rolled(h, np.arange(len(h) - group + 1), group)
    out = grams[start]
    for k in range(1, size - group + 1):
        np.minimum(out, grams[start + k], out=out)
    return out


def repeated(ids: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that have an equal among the others: their places, and a number that is equal just where all words are, ascending."""
    key = rolled(ids, start, size)
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    some = same[1:] | same[:-1]
    at, group = order[some], np.cumsum(~same[:-1])[some]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    lead = np.repeat(at[first], np.diff(np.append(first, len(at))))
    equal = np.ones(len(at), bool)
    for k in range(size):
        equal &= ids[start[at] + k] == ids[start[lead] + k]
    if not equal.all():  # equal hashes of different windows: told apart by their words
        seen: dict[tuple, int] = {}
        for i in np.flatnonzero(np.isin(group, group[~equal])):
            group[i] = seen.setdefault(tuple(ids[start[at[i]] : start[at[i]] + size].tolist()), len(key) + 1 + len(seen))
        order = np.argsort(group, kind="stable")
        at, group = at[order], group[order]
    return at, group


def earlier(ids: np.ndarray, start: np.ndarray, size: int, place: np.ndarray) -> np.ndarray:
    """Which windows stand in a document of an earlier place too. place: of each window's document."""
    out = np.zeros(len(start), bool)
    at, group = repeated(ids, start, size)
    if len(at):
        first = np.flatnonzero(np.diff(group, prepend=-1))
        least = np.repeat(np.minimum.reduceat(place[at], first), np.diff(np.append(first, len(at))))
        out[at] = place[at] > least
    return out


def runs(start: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of stretches in which start rises by 1 and all values stay, and their lengths."""
    new = np.ones(len(start), bool)
    new[1:] = start[1:] != start[:-1] + 1
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(start)))


def strings(block: Block, start: np.ndarray, words: np.ndarray) -> pa.Array:
    """The words start, start + 1, ... of each place, joined by spaces."""
    at = np.concatenate([[0], np.cumsum(words)])
    ids = block.ids[np.arange(at[-1]) + np.repeat(start - at[:-1], words)]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), block.names.take(pa.array(ids))), pa.scalar(" ", block.names.type))


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES, column: int = 2) -> Iterator[pa.Table]:
    """Rows together whose texts have about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        own = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        low, total = 0, np.cumsum(own)
        while low < len(batch):
            before = total[low - 1] if low else 0
            high = max(low + (not held), int(np.searchsorted(total, before + limit - size, "right")))
            if high > low:
                held.append(batch.slice(low, high - low))
                size += int(total[high - 1] - before)
                low = high
            if size >= limit or low < len(batch):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def ranks(ids: pa.Array) -> np.ndarray:
    """Places of document ids in ascending order, equal for equal ones; nulls share the last."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    null = np.asarray(ids.is_null())
    known, place = np.unique(ids.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)
    return np.where(null, len(known), place)


def parcels(rows: pa.RecordBatch, bucket: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """rows in one compressed string for each bucket: bucket, windows, size (bytes when unpacked), parcel."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows.take(pa.array(order)), bucket[order]
    total = np.concatenate([[0], np.cumsum(windows[order])])
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    codec, sizes, out = pa.Codec(CODEC, LEVEL), [], []
    for low, high in zip(first, [*first[1:], len(bucket)], strict=True):
        body = rows.slice(low, high - low).serialize()
        sizes.append(body.size)
        out.append(codec.compress(body, asbytes=True))
    ends = np.append(first[1:], len(bucket)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.array(total[ends] - total[first]), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["bucket", "windows", "size", "parcel"])


def unpacked(size: int, parcel: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.Codec(CODEC).decompress(parcel, decompressed_size=size), schema)


def schema_of(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", kind), ("twin", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("packed", pa.string())])


def travelling(table: pa.Table, large: np.ndarray, cell_shift: int, buckets: int, s: Settings) -> Iterator[pa.RecordBatch]:
    """table: doc_id, twin, text of a block; buckets: a power of 2. Parcels of rows doc_id, twin, start, n, packed.

    n windows from word `start` on, with their words in `packed`; or in one parcel with windows of -1, of any bucket and
    without words, those that stand in an earlier document of this block.
    """
    block = Block.of(table.column("text"))
    start = block.starts(s.size)
    if not len(start):
        return
    doc = np.searchsorted(block.doc, start, "right") - 1
    late = earlier(block.ids, start, s.size, ranks(table.column("doc_id"))[doc])
    hashes = block.hashes()
    least = minimisers(hashes, start, s.size, s.group)
    own = [table.column(k).combine_chunks() for k in ("doc_id", "twin")]
    schema = schema_of(own[0].type)

    def rows(at: np.ndarray, n: np.ndarray, packed: pa.Array) -> pa.RecordBatch:
        documents = pa.array(doc[at])
        place = (start[at] - block.doc[doc[at]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(c.take(documents) for c in own), pa.array(place), pa.array(n.astype(np.int32)), packed.cast(pa.string())], schema=schema)

    def dealt(h: np.ndarray) -> np.ndarray:
        return (mixed(h) & np.uint64(buckets - 1)).astype(np.int64)

    gone = np.flatnonzero(late)
    first, n = runs(start[gone], doc[gone])
    if len(gone):
        any_ = dealt(np.full(len(first), int(least[0]), np.uint64))
        yield parcels(rows(gone[first], n, pa.nulls(len(first), pa.string())), any_, np.full(len(first), -1)).set_column(1, "windows", pa.array([-1]))
    many = ~late & np.isin(least >> np.uint64(cell_shift), large) if len(large) else np.zeros(len(start), bool)
    alone = np.flatnonzero(many)
    for low in range(0, len(alone), 1 << 17):
        at = alone[low : low + (1 << 17)]
        one = np.ones(len(at), np.int64)
        yield parcels(rows(at, one, strings(block, start[at], s.size * one)), dealt(rolled(hashes, start[at], s.size)), one)
    some = np.flatnonzero(~late & ~many)
    first, n = runs(start[some], doc[some], least[some], (start[some] - block.doc[doc[some]]) // s.longest)
    ends, low = np.cumsum(n + s.size - 1), 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + s.packed, "right")))
        at, own_n = some[first[low:high]], n[low:high]
        yield parcels(rows(at, own_n, strings(block, start[at], own_n + s.size - 1)), dealt(least[at]), own_n)
        low = high


def judged(table: pa.Table, size: int) -> pa.RecordBatch:
    """table: all travelling rows that may hold equal windows: doc_id, twin, start, n of those that stand in an earlier document."""
    block = Block.of(table.column("packed"))
    start = block.starts(size)
    row = np.searchsorted(block.doc, start, "right") - 1
    late = np.flatnonzero(earlier(block.ids, start, size, ranks(table.column("doc_id"))[row]))
    at = table.column("start").to_numpy()[row[late]] + start[late] - block.doc[row[late]]
    first, n = runs(at, row[late])
    own = pa.array(row[late][first])
    return pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks().take(own) for k in ("doc_id", "twin")), pa.array(at[first]), pa.array(n)], names=["doc_id", "twin", "start", "n"])


def picked(rows: pa.RecordBatch, size: int, part: int, parts: int) -> pa.RecordBatch:
    """The windows of a part, by their hashes, as rows of their own."""
    block = Block.of(rows.column(4))
    start = block.starts(size)
    start = start[rolled(block.hashes(), start, size) % np.uint64(parts) == part]
    row = np.searchsorted(block.doc, start, "right") - 1
    one = np.ones(len(start), np.int32)
    place = rows.column(2).to_numpy()[row] + (start - block.doc[row]).astype(np.int32)
    return pa.RecordBatch.from_arrays([*(rows.column(k).take(pa.array(row)) for k in (0, 1)), pa.array(place), pa.array(one), strings(block, start, size * one.astype(np.int64)).cast(pa.string())], schema=rows.schema)


def settled(batches: Iterator[pa.RecordBatch], kind: pa.DataType, s: Settings) -> Iterator[pa.RecordBatch]:
    """Parcels of `travelling` by bucket: doc_id, twin, start, n of windows that stand in an earlier document.

    Only a bucket's parcels are held; if they have many windows, these are unpacked and judged a part at a time.
    """
    schema, held, now = schema_of(kind), [], None

    def done() -> Iterator[pa.RecordBatch]:
        total = sum(w for w, _, _ in held)
        if total <= BUCKET_MOST * s.bucket:
            if held:
                yield judged(pa.Table.from_batches([unpacked(size, p, schema) for _, size, p in held]), s.size)
            return
        parts = -(-total // s.bucket)
        for part in range(parts):
            yield judged(pa.Table.from_batches([picked(unpacked(size, p, schema), s.size, part, parts) for _, size, p in held]), s.size)

    for batch in batches:
        for bucket, windows, size, parcel in zip(*(batch.column(k) for k in range(4)), strict=True):
            windows, size, parcel = windows.as_py(), size.as_py(), parcel.as_buffer()
            if windows < 0:
                out = unpacked(size, parcel, schema)
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), out.column(2).cast(pa.int64()), out.column(3).cast(pa.int64())], names=["doc_id", "twin", "start", "n"])
                continue
            if bucket.as_py() != now:
                yield from done()
                held, now = [], bucket.as_py()
            held.append((windows, size, parcel))
    yield from done()


def kept_words(table: pa.Table, size: int) -> pa.RecordBatch:
    """table: doc_id, text, and the windows to remove as lists of start and n: doc_id, n_words, n_removed, kept_text."""
    block = Block.of(table.column(1))
    lists = table.column(2).combine_chunks()
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())])
    first, n = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    first = first + np.repeat(block.doc[:-1], np.diff(at))
    edge = np.bincount(first, minlength=len(block.ids) + 1) - np.bincount(first + n + size - 1, minlength=len(block.ids) + 1)
    gone = np.cumsum(edge)[: len(block.ids)] > 0
    count = np.concatenate([[0], np.cumsum(~gone)])[block.doc]
    words = np.diff(block.doc)
    text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(count), block.names.take(pa.array(block.ids[~gone]))), pa.scalar(" ", block.names.type))
    return pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(words), pa.array(words - np.diff(count)), text.cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def deduplicated(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs: doc_id, text; other columns are not read. Removes each word of a window (WINDOW words in a row, as they stand)
    that also starts in a document with a smaller doc_id; what is judged is the input.

    Returns doc_id, n_words, n_removed, kept_text (the words left, joined by a space) and kept_sha256, a row for each input
    row. Null texts have no words; texts shorter than a window lose none. A window repeated only within a document stays, as
    do those shared by rows of one doc_id. Rows without an id come after all others and share windows among themselves
    freely. An empty table gives an empty result.
    """
    s = settings or Settings()
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    # rows of one doc_id are told apart by their text; where there are none, nothing travels for it
    alone = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    twin = F.lit(0).cast("long") if alone else F.xxhash64(F.col("doc_id").isNull(), "text")
    rows = docs.select("doc_id", twin.alias("twin"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.filter(F.length("text") >= 2 * s.size - 1)
    shift = 64 - max(CELL_BITS, (docs.rdd.getNumPartitions() * CELLS - 1).bit_length())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, s.block):
            block = Block.of(table.column(2))
            cell, n = np.unique(minimisers(block.hashes(), block.starts(s.size), s.size, s.group) >> np.uint64(shift), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    cells = written(texts.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "window-cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    large = cells.filter(F.col("n") > max(s.large, total // HEAVIEST)).select("cell").toArrow()
    sent = spark.sparkContext.broadcast(large.column(0).to_numpy().astype(np.uint64))
    forget(cells)
    buckets = 1 << max(0, (total // s.bucket)).bit_length()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, s.block):
            yield from travelling(table, sent.value, shift, buckets, s)

    name = kind.simpleString()
    moved = texts.mapInArrow(packed, "bucket long, windows long, size long, parcel binary").repartition("bucket").sortWithinPartitions("bucket")
    found = drained(moved.mapInArrow(lambda b: settled(b, arrow, s), f"doc_id {name}, twin long, start long, n long"), "window-ranges")
    ranges = found.groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), "twin").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))
    joined = rows.withColumn("id", F.coalesce("doc_id", F.lit(0))).join(ranges, ["id", "twin"], "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, s.block, column=1):
            yield kept_words(table, s.size)

    return joined.mapInArrow(cut, f"doc_id {name}, n_words long, n_removed long, kept_text string").withColumn("kept_sha256", F.sha2("kept_text", 256))
