"""License scans by diagonal voting.

All rolling word pairs of all texts are hashed and joined with the pairs of the templates (a fixed, small table). A hit
at word p of a text and word t of a template votes for the diagonal p - t. Votes are counted by text, template and
diagonal; diagonals a few words apart are merged, which bridges inserted and dropped words. Spans with enough votes
are verified on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .quality import NOT_WORD
from .words import Words, chunks, shingles, split

#: Fixed phrases and their labels: every place where the words stand in a row counts.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Fixed passages of public licenses, of any length, and their labels.
PASSAGES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2.0-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "mpl-2.0-text": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "cc-by-text": "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}

GRAM = 2
#: Diagonals at most so far apart are merged; shares of a passage's pairs (votes) and words (verified) that make a span.
GAP, VOTES, VERIFIED = 4, 0.5, 0.7
#: Places of a template that a bit mask holds; longer templates have several masks.
MASK_BITS = 63
#: Candidate spans are broadcast up to so many (about 40 bytes each), else joined by a shuffle.
BROADCAST_SPANS = 500_000
#: Stands for the end of every text, so that each text comes through the join.
LAST = 0x1CE25EE25EE25EE


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrase: bool


TEMPLATES = [Template(label, tuple(p.encode().split()), True) for p, label in PHRASES.items()] + [Template(label, tuple(p.encode().split()), False) for label, p in PASSAGES.items()]


def grams(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows: number of words, and the hashes of all word pairs, LAST after them, with bounds."""
    for rows, body, at in chunks(column):
        words = split(body, at, NOT_WORD)
        h, first = shingles(words, GRAM)
        n = words.counts()
        alone = first[:-1][n == 1]
        h[alone] = 0
        yield rows, n, np.insert(h, first[1:], np.uint64(LAST)), first + np.arange(len(first))


def template_table(spark: SparkSession) -> DataFrame:
    """h, template, at: a row for each word pair of each template, and one for the end of a text (template -1)."""
    rows = [(LAST, -1, 0)]
    for k, t in enumerate(TEMPLATES):
        _, _, h, _ = next(grams(pa.array([b" ".join(t.words).decode()])))
        rows += [(int(x), k, i) for i, x in enumerate(h[:-1].view(np.int64))]
    return spark.createDataFrame(rows, "h long, template int, at int")


def _lined_up(template: tuple[bytes, ...], words: list[bytes]) -> int:
    """Longest common subsequence."""
    row = np.zeros(len(words) + 1, np.int64)
    for t in template:
        same = np.array([w == t for w in words], bool)
        now = np.maximum(row[1:], np.where(same, row[:-1] + 1, 0))
        row = np.concatenate([[0], np.maximum.accumulate(now)])
    return int(row[-1])


def verified(words: Words, low: int, high: int, spans: list[dict]) -> dict:
    """low, high: the text's words. spans: template, start, end (words of the text). What the text's row says of its licenses."""
    places, base, labels, score = [], set(), set(), 0.0
    for s in spans:
        t = TEMPLATES[s["template"]]
        own = [words.word(i) for i in range(low + max(0, s["start"]), min(high, low + s["end"]))]
        if t.phrase:
            if tuple(own) == t.words:
                places.append(s["start"])
                base.add(t.label)
                score = 1.0
            continue
        share = _lined_up(t.words, own) / len(t.words)
        if share >= VERIFIED:
            labels.add(t.label)
            score = max(score, share)
    return {"n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": float(score)}


def scanned(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text; other columns are not read. One row an input row:

    doc_id, n_words, n_base (places of the phrases), first_word and last_word (their least and greatest start; null
    without), base_labels, labels (with those of verified passages), score (1 with a phrase, else the best verified
    share of a passage, else 0). Labels are distinct, sorted and joined by commas.

    Words are A-Z lower-cased runs of ASCII digits, letters and all non-ASCII characters. A null text is empty. Texts of
    any length are read whole, in slices. Ids may be null; repeated rows get equal results. Of equally good passages all
    are named. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, n, h, first in grams(batch.column(2)):
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], pa.array(n.astype(np.int64)), lists], names=["rid", "doc_id", "n_words", "grams"])

    hashed = texts.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n_words long, grams array<long>")
    hits = hashed.select("rid", "doc_id", "n_words", F.posexplode("grams").alias("pos", "h")).join(F.broadcast(template_table(spark)), "h")
    diagonal = F.when(F.col("template") >= 0, F.col("pos") - F.col("at")).otherwise(0).alias("diagonal")
    masks = math.ceil(max(len(t.words) for t in TEMPLATES) / MASK_BITS)
    parts = [F.when(F.expr(f"at div {MASK_BITS} = {k}"), F.expr(f"shiftleft(1L, at % {MASK_BITS})")).otherwise(0).cast("long") for k in range(masks)]
    votes = hits.groupBy("rid", "doc_id", "n_words", "template", diagonal).agg(
        *(F.bit_or(part).alias(f"mask{k}") for k, part in enumerate(parts)), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("copies"),
    )
    votes = written(votes, "license-votes")
    size = F.element_at(F.array(*[F.lit(len(t.words)) for t in TEMPLATES]), F.col("template") + 1)
    phrase = F.col("template") < len(PHRASES)
    cast = sum((F.bit_count(f"mask{k}") for k in range(1, masks)), F.bit_count("mask0"))
    phrases = votes.filter((F.col("template") >= 0) & phrase & (cast == size - GRAM + 1)).select("rid", "template", F.col("diagonal").alias("start"), (F.col("diagonal") + size).alias("end"))
    along = Window.partitionBy("rid", "template").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= GAP, 0).otherwise(1)
    bands = votes.filter((F.col("template") >= 0) & ~phrase).withColumn("_new", new).withColumn("band", F.sum("_new").over(along))
    bands = bands.groupBy("rid", "template", "band").agg(*(F.bit_or(f"mask{k}").alias(f"mask{k}") for k in range(masks)), F.min("low").alias("start"), F.max("high").alias("end"))
    bands = bands.filter(cast >= VOTES * (size - GRAM + 1)).select("rid", "template", "start", (F.col("end") + GRAM).alias("end"))
    spans = phrases.unionByName(bands).select("rid", F.struct("template", "start", "end").alias("span"))
    spans = written(spans.groupBy("rid").agg(F.collect_list("span").alias("spans")), "license-spans")
    many = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    small = F.broadcast(spans) if many <= BROADCAST_SPANS else spans

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, body, at in chunks(batch.column(1)):
                words = split(body, at, NOT_WORD)
                for k, own in enumerate(batch.column(2)[rows].to_pylist()):
                    out.append(verified(words, words.doc[k], words.doc[k + 1], own))
            names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[c] for x in out], t) for c, t in zip(names, kinds, strict=True))], names=["rid", *names])

    found = texts.join(small, "rid").select("rid", "text", "spans").mapInArrow(check, "rid long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").dropDuplicates(["rid"])
    rows = votes.filter("template = -1").select("rid", "doc_id", "n_words", F.explode(F.expr("sequence(1L, copies)"))).drop("col")
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    out = rows.join(found, "rid", "left")
    return out.select("doc_id", "n_words", *(F.coalesce(F.col(c), F.lit(none[c])).alias(c) if c in none else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score"))).withColumn("n_base", F.col("n_base").cast("long"))
