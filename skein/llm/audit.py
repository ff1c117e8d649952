"""What each filter of a chain removes, in every order of the chain, and its fair share of all that goes.

The documents that a set of filters removes are a multilinear polynomial of the filters, with a variable for each: 1 where
the filter is on, 0 where it is off. Its coefficients follow from the counts of the sets of filters that documents fail.
At a corner it gives what that set of filters removes; the integral of a partial derivative along the diagonal is the
filter's Shapley value (Owen's multilinear extension), here an exact rational.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
#: What a document is counted as, besides as one: labelled good, labelled toxic.
COUNTS = ("n", "good", "toxic")


class Removal:
    """Removal polynomials of many parts. counts: parts x 2**filters, documents that fail just the filters of the mask."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.shape[1].bit_length() - 1
        masks = np.arange(1 << self.n)
        self.size = np.array([int(m).bit_count() for m in masks])
        self.total = counts.sum(axis=1)
        self._within = (masks[:, None] & masks[None, :]) == masks[:, None]  # [a, b]: a is a subset of b
        # 1 - prod(1 - x) over a mask, expanded: a product of variables stands in all masks that hold it, with a sign by its size
        self.coefficients = counts @ self._within.T.astype(np.int64) * np.where(self.size % 2, 1, -1) * (self.size > 0)
        self.corners = self.coefficients @ self._within.astype(np.int64)

    def shapley(self, i: int) -> np.ndarray:
        """The integral over t from 0 to 1 of the derivative by filter i, all variables at t; times the number of orders.

        The derivative of a product with s variables is one with s - 1, whose integral is 1/s.
        """
        weights = [Fraction(factorial(self.n), int(s)) if m >> i & 1 else Fraction(0) for m, s in enumerate(self.size)]
        assert all(w.denominator == 1 for w in weights)  # s divides the number of orders
        return self.coefficients @ np.array([int(w) for w in weights])


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text, source; labels: doc_id, quality, toxic. A row for each part and mask that occurs: part, mask, n, good, toxic.

    A: under 200 words. B: fewer than half of the words differ. C: over 2 % of the characters are of A-Z. D: holds one of #$%&*|.
    E: the text is that of a row with a smaller doc_id, in whatever part and whether that row stays or not; rows without an id
    come after all others and are no copies of each other, nor are rows of the same id. A null text is empty, a null source
    the empty string. Texts are compared by SHA-256. Of several labels of a document one that says 1 is enough.
    """
    text = F.coalesce("text", F.lit(""))
    seen = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    words, chars = F.size("words"), F.length("text")
    fails = (words < 200, 100 * F.size(F.array_distinct("words")) < 50 * words, 100 * (chars - F.length(F.regexp_replace("text", "[A-Z]", ""))) > 2 * chars, F.col("text").rlike("[#$%&*|]"))
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))
    seen = seen.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), mask.alias("mask"))
    said = labels.groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = written(seen.join(said, "doc_id", "left").select(*seen.columns, F.lit(1).cast("long").alias("n"), *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[1:])), "audit-rows")
    # Those first of their text are found by text and id together, so that no text, however common, gathers its rows anywhere
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"))
    least = rows.alias("r").join(first.alias("f"), (F.col("r.key") == F.col("f.key")) & F.col("r.doc_id").eqNullSafe(F.col("f.first"))).select("r.part", "r.mask", *(f"r.{c}" for c in COUNTS))
    copy = F.col("mask").bitwiseOR(1 << 4)
    signed = rows.select("part", copy.alias("mask"), *COUNTS).unionByName(least).unionByName(least.select("part", copy.alias("mask"), *((-F.col(c)).alias(c) for c in COUNTS)))
    return signed.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS)).filter("n > 0")


def audited(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """masks: as `failing` gives them, for filters named by a letter each. A row for each part, order of the filters, and step.

    part, filter_order, step (from 1), kept (after the step), removed (here), redundant (failing its filter, removed
    earlier), unique_fails (failing its filter only), good_lost and toxic_lost (removed here), shapley (the filter's
    Shapley value times the number of orders: what it removes, summed over all orders). No masks: no rows.
    """
    cells, n = 1 << len(filters), len(filters)
    steps = [("".join(filters[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in permutations(range(n)) for k in range(n)]
    orders = pa.array([s[0] for s in steps])
    number, before, at = (np.array([s[j] for s in steps]) for j in (1, 2, 3))
    bit = 1 << at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                cell = batch.column(1)[row].as_py()
                counts = np.zeros((len(COUNTS), cells), np.int64)
                for c in cell:
                    counts[:, c["mask"]] = [c[k] for k in COUNTS]
                own = Removal(counts)
                r = own.corners
                after = r[:, before | bit]
                removed = after - r[:, before]
                shares = np.stack([own.shapley(i) for i in range(n)])[at, 0]
                columns = (own.total[0] - after[0], removed[0], r[0, bit] - removed[0], r[0, -1] - r[0, (cells - 1) ^ bit], removed[1], removed[2], shares)
                part = pa.array([batch.column(0)[row].as_py()] * len(steps), pa.string())
                yield pa.RecordBatch.from_arrays([part, orders, pa.array(number.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in columns)], names=names)

    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[3:])
    cells_of = masks.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # one for each mask at most
    return cells_of.mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters on all documents, by source. Other columns are not read; repeated rows count each time."""
    return audited(failing(docs, labels))
