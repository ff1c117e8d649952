"""Scans under a budget: results as of a plain scan, and an end on time with counts that add up."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import scans


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcxyz "), int(rng.integers(0, 30))))
    out = [(i, "\n".join(word() for _ in range(int(rng.integers(0, 30)))) + str(rng.choice(["", "\n", "\n\n"]))) for i in range(300)]
    return [*out, (900, None), (901, ""), (902, "\n"), (903, "ABC\r\nabc"), (904, "x" * 3_000_000 + "\nabc")]


@pytest.mark.parametrize("pattern", ["a.*b", "^abc", "abc$", r"(a)b\1", r"a(?=b)", "z"])
@pytest.mark.parametrize("ignore", [True, False])
def test_equals_a_plain_scan(spark, texts, pattern, ignore):
    assert scans.Matcher.of(pattern).linear == (pattern not in (r"(a)b\1", r"a(?=b)"))
    df = spark.createDataFrame(texts, "file long, text string").repartition(4)
    status, totals, hits = scans.scan_lines(df, pattern, ignore, 600, per_file=3, in_all=50)
    want, size, files = [], 0, 0
    for i, t in texts:
        lines = (t or "").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        size += len(lines)
        own = [(i, k, x[:400]) for k, x in enumerate(lines, 1) if re.search(pattern, x, re.I if ignore else 0)]
        files += bool(own)
        want.append([(*o, len(own)) for o in own])
    assert (status, totals) == ("COMPLETE", {"files": len(texts), "scanned": len(texts), "with_hits": files, "hits": sum(map(len, want)), "size": size})
    assert [tuple(r) for r in hits.collect()] == [h for own in want for h in own[:3]][:50]


def test_a_catastrophic_pattern_is_linear_or_stopped(spark):
    """A pattern of RE2 takes no time on a text that holds a backtracking matcher up for ever; one with a reference is stopped."""
    df = spark.createDataFrame([(i, "a" * 40 + "!") for i in range(60)] + [(1000, "b")], "file long, text string").repartition(4)
    status, totals, _ = scans.scan_lines(df, r"^(a+)+$", seconds=60)
    assert status == "COMPLETE" and totals["hits"] == 0
    began = time.time()
    status, totals, _ = scans.scan_lines(df, r"(?=a)(a|a)*$", seconds=2)
    took = time.time() - began
    assert status == "INCOMPLETE" and totals["scanned"] < totals["files"] == 61 and took < 20
    tracker = spark.sparkContext.statusTracker()
    assert not tracker.getActiveStageIds() and not tracker.getActiveJobsIds()


def test_unscanned_files_are_counted(spark, texts):
    df = spark.createDataFrame(texts, "file long, text string").repartition(4)
    status, totals, hits = scans.scan_lines(df, "a", seconds=-1)
    assert (status, totals) == ("INCOMPLETE", {"files": len(texts), "scanned": 0, "with_hits": 0, "hits": 0, "size": 0}) and hits.count() == 0


def test_sections(spark):
    rows = [("f", 1, "1", "one th"), ("f", 2, "1", "ing"), ("f", 3, None, "thing thing"), ("f", 4, "2", "none"), ("g", 1, "1", "THING")]
    chunks = spark.createDataFrame(rows, "file string, chunk_idx int, section string, text string")
    status, totals, hits = scans.scan_sections(chunks, r"th\s*ing")
    assert (status, totals) == ("COMPLETE", {"sections": 4, "scanned": 4, "with_hits": 3, "hits": 4, "size": 30}) and [tuple(r) for r in hits.collect()] == [("f", 1, "1", 1), ("f", 3, None, 2), ("g", 1, "1", 1)]
    assert scans.scan_sections(chunks, "x", seconds=-1)[:2] == ("INCOMPLETE", {"sections": 4, "scanned": 0, "with_hits": 0, "hits": 0, "size": 0})
    with pytest.raises(scans.PatternError):
        scans.scan_lines(chunks, "(")


def test_facade(spark):
    from skein.engine import Engine

    files = spark.createDataFrame([("c", "a", "one\ntwo\nthree\nfour"), ("c", "b", "two"), ("c", "raw/x", "two")], "corpus string, relpath string, text string")
    engine = Engine(spark, {"files": files})
    status, totals, hits = engine.grep_bounded("c", "T.O")
    assert status == "COMPLETE" and totals["files"] == 2 and [(r.file, r.line) for r in hits.collect()] == [("a", 2), ("b", 1)]
    got = engine.grep_report("c", "two", context=1)
    assert [(r.file, r.line) for r in got["lines"].collect()] == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert [tuple(r) for r in got["totals"].collect()] == [(2, 5, 2, 2)] and got["hits"].select(F.sum("in_file")).first()[0] == 2
