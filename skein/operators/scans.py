"""Scans for a pattern that end when their time is over and say what they covered.

Patterns run in linear time (RE2, over Arrow batches), so no text can hold a task up. Those that need backtracking
(references to groups, conditions to the left or right) run in a matcher that looks at the clock itself. Every task knows
the end of the budget: past it, what it has not scanned is counted and nothing else, so cores are free at once and no
job has to be cancelled.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from skein.scratch import written

from .reads import IN_ALL, LINE_CHARS, PER_FILE, section_runs

#: Seconds of a scan, and bytes of text between two looks at the clock.
BUDGET, SLICE_BYTES = 20.0, 1 << 20


class PatternError(ValueError):
    pass


@dataclass
class Matcher:
    """A pattern and how to run it."""

    pattern: str
    ignore_case: bool
    linear: bool

    @staticmethod
    def of(pattern: str, ignore_case: bool = False) -> Matcher:
        try:
            pc.count_substring_regex(pa.array(["x"]), pattern, ignore_case=ignore_case)
            return Matcher(pattern, ignore_case, True)
        except pa.ArrowInvalid:
            pass
        try:
            regex.compile(pattern)
        except regex.error as e:
            raise PatternError(f"{pattern!r}: {e}") from e
        return Matcher(pattern, ignore_case, False)

    def counts(self, texts: pa.Array, until: float) -> np.ndarray:
        """Matches in each text, not overlapping; TimeoutError if the clock passes `until` first."""
        if self.linear:
            return pc.count_substring_regex(texts, self.pattern, ignore_case=self.ignore_case).to_numpy(zero_copy_only=False).astype(np.int64)
        found, compiled = np.zeros(len(texts), np.int64), regex.compile(self.pattern, regex.IGNORECASE if self.ignore_case else 0)
        for k, text in enumerate(texts.to_pylist()):
            found[k] = sum(1 for _ in compiled.finditer(text, timeout=max(until - time.time(), 1e-6)))
        return found


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Rows of about SLICE_BYTES; a longer text alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE_BYTES, "right")))
        yield slice(low, high)
        low = high


def timed(rows: DataFrame, measure: Callable[[pa.RecordBatch, float], pa.RecordBatch], schema: str, seconds: float) -> DataFrame:
    """What `measure` makes of the rows (their last column is a text, not null) before the budget ends: a table with `scanned`.

    Rows that `measure` could not finish are there once each, with nulls and scanned = false. Tasks that start late return
    at once. The table is written, so that it is the outcome of one run.
    """
    end = time.time() + seconds
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    keep = [c for c in rows.columns[:-1] if c in names]
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch.column(batch.num_columns - 1)):
                one = batch.slice(part.start, part.stop - part.start)
                try:
                    if time.time() > end:
                        raise TimeoutError
                    out = measure(one, end)
                    yield out.append_column("scanned", pa.array(np.ones(len(out), bool)))
                except TimeoutError:
                    left = {c: one.column(one.schema.get_field_index(c)) if c in keep else None for c in names}
                    kinds = {f.name: f.type for f in arrow}
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(one), kinds[c]) if v is None else v for c, v in left.items()] + [pa.array(np.zeros(len(one), bool))], names=[*names, "scanned"])

    return written(rows.mapInArrow(run, f"{schema}, scanned boolean"), "timed-scan")


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lines of all texts, the text of each, and its number; a line feed at the end opens no line."""
    lists = pc.split_pattern(texts, "\n")
    flat, at = lists.flatten(), np.asarray(lists.offsets, np.int64)
    at = at - at[0]
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    number = np.arange(len(flat)) - at[owner] + 1
    keep = np.ones(len(flat), bool)
    last = at[1:] - 1
    keep[last[pc.equal(flat.take(pa.array(last)), "").to_numpy(zero_copy_only=False)]] = False
    return flat.filter(pa.array(keep)), owner[keep], number[keep]


def _totals(got: DataFrame, texts: str) -> dict[str, int]:
    row = got.filter("line IS NULL" if "line" in got.columns else "true").agg(
        F.count("*").alias(texts), F.count_if("scanned").alias("scanned"), F.count_if(F.col("hits") > 0).alias("with_hits"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")
    )
    return row.first().asDict()


def status(totals: dict[str, int], texts: str) -> str:
    """`INCOMPLETE` where anything was left: then totals are those of what was scanned, and say nothing of the rest."""
    return "COMPLETE" if totals["scanned"] == totals[texts] else "INCOMPLETE"


def scan_lines(files: DataFrame, pattern: str, ignore_case: bool = True, seconds: float = BUDGET, per_file: int = PER_FILE, in_all: int = IN_ALL) -> tuple[str, dict[str, int], DataFrame]:
    """Status, totals, and the first matching lines: file, line, line_text, in_file (the true number of the file).

    files: file, text. Totals: files, scanned, with_hits, hits (matching lines) and size (lines), of what was scanned. At most
    `per_file` lines of a file leave its task, and `in_all` are returned, in the order of files and lines.
    """
    matcher = Matcher.of(pattern, ignore_case)
    kind = dict(files.dtypes)["file"]

    def measure(batch: pa.RecordBatch, until: float) -> pa.RecordBatch:
        flat, owner, number = _lines(batch.column(1))
        hit = np.flatnonzero(matcher.counts(flat, until) > 0)
        hits, size = np.bincount(owner[hit], minlength=len(batch)), np.bincount(owner, minlength=len(batch))
        first = np.concatenate([[0], np.cumsum(hits)])[:-1]
        shown = hit[np.arange(len(hit)) - first[owner[hit]] < per_file]
        n = len(batch)
        files_ = batch.column(0).take(pa.array(np.concatenate([np.arange(n), owner[shown]])))
        line = pa.array(np.concatenate([np.zeros(n, np.int64), number[shown]]).astype(np.int32), mask=np.arange(n + len(shown)) < n)
        text = pa.concat_arrays([pa.nulls(n, pa.string()), pc.utf8_slice_codeunits(flat.take(pa.array(shown)), 0, LINE_CHARS).cast(pa.string())])
        count = np.concatenate([hits, hits[owner[shown]]])
        return pa.RecordBatch.from_arrays([files_, line, text, pa.array(count), pa.array(np.concatenate([size, np.zeros(len(shown), np.int64)]))], names=["file", "line", "line_text", "hits", "size"])

    rows = files.select("file", F.coalesce("text", F.lit("")).alias("text"))
    got = timed(rows, measure, f"file {kind}, line int, line_text string, hits long, size long", seconds)
    totals = _totals(got, "files")
    shown = got.filter("line IS NOT NULL").orderBy("file", "line").limit(in_all)
    return status(totals, "files"), totals, shown.select("file", "line", "line_text", F.col("hits").alias("in_file"))


def scan_sections(chunks: DataFrame, pattern: str, ignore_case: bool = True, seconds: float = BUDGET, per_file: int = 3, in_all: int = IN_ALL) -> tuple[str, dict[str, int], DataFrame]:
    """As `scan_lines`, of the sections that chunks make together, so that a match may cross a chunk's end.

    chunks: file, chunk_idx, section, text. Totals: sections, scanned, with_hits, hits, size (characters). The first sections of
    each file with a match: file, first (chunk), section, hits.
    """
    matcher = Matcher.of(pattern, ignore_case)
    kinds = dict(chunks.dtypes)

    def measure(batch: pa.RecordBatch, until: float) -> pa.RecordBatch:
        text = batch.column(3)
        size = pc.utf8_length(text).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(matcher.counts(text, until)), size], names=["file", "first", "section", "hits", "size"])

    rows = section_runs(chunks).select("file", "first", "section", "text")
    got = timed(rows, measure, f"file {kinds['file']}, first {kinds['chunk_idx']}, section {kinds['section']}, hits long, size long", seconds)
    totals = _totals(got, "sections")
    place = F.row_number().over(Window.partitionBy("file").orderBy("first"))
    shown = got.filter("hits > 0").withColumn("_n", place).filter(F.col("_n") <= per_file).orderBy("file", "first").limit(in_all)
    return status(totals, "sections"), totals, shown.select("file", "first", "section", "hits")
