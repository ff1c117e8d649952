"""Published vector indexes: a manifest, centroids and cluster files of header, int8 rows and a JSON tail (C29 to C32); int8 codecs (C20).

    manifest.json   build, model, scale and counts      centroids.bin   int8 rows
    sources.json    digests of the texts                clusters/NNNN.bin   int8 rows, byte ranges and titles
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import unpaged
from skein.scratch import written

#: Fixed format: magic, version, dimensions, rows, number of the cluster, bytes of the tail, zero.
HEADER = struct.Struct("<4sHHIIII")
CENTROIDS, CLUSTER, VERSION = b"RFCV", b"RFCC", 1
CHUNK = "cluster_id int, doc string, off long, len long, section string, title string, code array<tinyint>"


class FormatError(ValueError):
    pass


def encoded(rows: np.ndarray, ident: int = 0, tail: dict | None = None, magic: bytes = CLUSTER) -> bytes:
    meta = json.dumps(tail).encode() if tail is not None else b""
    return HEADER.pack(magic, VERSION, rows.shape[1], len(rows), ident, len(meta), 0) + rows.astype(np.int8).tobytes() + meta


def decoded(content: bytes, magic: bytes = CLUSTER) -> tuple[int, np.ndarray, dict]:
    """Number, int8 rows and tail of one file; anything that doesn't add up is an error."""
    if len(content) < HEADER.size:
        raise FormatError("shorter than its header")
    found, version, dims, count, ident, meta, zero = HEADER.unpack_from(content)
    if found != magic or version != VERSION or zero:
        raise FormatError(f"header {found!r} version {version}")
    if len(content) != HEADER.size + dims * count + meta:
        raise FormatError("size and header differ")
    rows = np.frombuffer(content, np.int8, dims * count, HEADER.size).reshape(count, dims)
    tail = json.loads(content[HEADER.size + dims * count :]) if meta else {}
    if tail and any(len(tail[k]) != count for k in ("rfc", "off", "len", "sec", "title")) or tail.get("n", count) != count:
        raise FormatError("columns of the tail differ in length")
    return ident, rows, tail


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of all cluster files below a folder, strings resolved; a section of -1 is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                ident, rows, t = decoded(bytes(content))
                texts = t.get("str", [])
                yield pd.DataFrame({
                    "cluster_id": ident, "doc": t["rfc"], "off": t["off"], "len": t["len"], "section": [texts[s] if s >= 0 else None for s in t["sec"]],
                    "title": [texts[s] for s in t["title"]], "code": list(rows),
                })

    return files.select("content").mapInPandas(run, CHUNK)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                _, rows, _ = decoded(bytes(content), CENTROIDS)
                yield pd.DataFrame({"cluster_id": np.arange(len(rows), dtype="int32"), "code": list(rows)})

    return files.select("content").mapInPandas(run, "cluster_id int, code array<tinyint>")


def codec_scale(meta: dict[str, str]) -> float | None:
    """C20: the scale of int8 vectors, None for floats; int8 without a positive scale is an error."""
    if meta.get("vector_encoding", "float32") == "float32":
        return None
    scale = float(meta.get("vector_scale") or 0)
    if scale <= 0:
        raise FormatError("int8 vectors need a positive scale")
    return scale


#: Fields that a manifest must have.
REQUIRED = ("build", "source.commit", "model.id", "model.dims", "quant.scale", "chunks.count", "clusters.count")


def manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """Fields of `manifest.json` by their dotted names; one that is missing, or another version, is an error."""
    text = spark.read.text(f"{path}/manifest.json", wholetext=True).first()
    try:
        raw = json.loads(text[0])
    except (TypeError, json.JSONDecodeError) as e:
        raise FormatError(f"manifest.json: {e}") from e

    def flat(node: dict, name: str = "") -> dict[str, str]:
        return {k2: v2 for k, v in node.items() for k2, v2 in (flat(v, f"{name}{k}.") if isinstance(v, dict) else {f"{name}{k}": v}).items() if v2 is not None}

    got = flat(raw)
    if missing := [k for k in REQUIRED if k not in got]:
        raise FormatError(f"manifest.json: no {', '.join(missing)}")
    if int(got.get("version", -1)) != VERSION:
        raise FormatError(f"manifest.json: version {got.get('version')}")
    return {k: str(v) for k, v in got.items()}


def checked(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """The whole index in one job: a row for each fault (file, fault), and totals over everything.

    Every file is decoded where it is read; only counts come back. Faults: a file that can't be decoded, of other
    dimensions, of a number that isn't its name's; a cluster that is missing or of no use to the manifest; a wrong total.
    """
    want = manifest(spark, path)
    dims, clusters, chunks = (int(want[k]) for k in ("model.dims", "clusters.count", "chunks.count"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, content in zip(f["path"], f["content"], strict=True):
                file = name.rsplit("/", 1)[-1]
                centroids = file == "centroids.bin"
                row = {"file": file, "ident": None, "n": 0, "sectioned": 0, "docs": [], "fault": None}
                try:
                    ident, rows, tail = decoded(bytes(content), CENTROIDS if centroids else CLUSTER)
                    texts, n = tail.get("str", []), len(rows)
                    row |= {"ident": -1 if centroids else ident, "n": n, "docs": sorted({str(x) for x in tail.get("rfc", [])}), "sectioned": sum(s >= 0 for s in tail.get("sec", []))}
                    numbers = [*tail.get("title", []), *(s for s in tail.get("sec", []) if s >= 0)]
                    if n and rows.shape[1] != dims:
                        row["fault"] = f"{rows.shape[1]} dimensions, not {dims}"
                    elif centroids and n != clusters:
                        row["fault"] = f"{n} centroids for {clusters} clusters"
                    elif not centroids and (n and not tail or any(not 0 <= k < len(texts) for k in numbers)):
                        row["fault"] = "rows without a description"
                    elif not centroids and file != f"{ident:04d}.bin":
                        row["fault"] = f"declares cluster {ident}"
                except (FormatError, ValueError, KeyError, TypeError) as e:
                    row["fault"] = str(e)[:200] or type(e).__name__
                out.append(row)
            yield pd.DataFrame(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(path)
    got = files.select("path", "content").mapInPandas(read, "file string, ident int, n long, sectioned long, docs array<string>, fault string")
    got = written(got, "index-check")
    lists = got.filter("file <> 'centroids.bin'")
    sums = lists.agg(F.sum("n").alias("chunks"), F.count("*").alias("clusters"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("sectioned").alias("sectioned")).first().asDict()
    sums = {k: v or 0 for k, v in sums.items()} | {"documents": lists.select(F.explode("docs")).distinct().count(), "centroids": got.filter("file = 'centroids.bin'").agg(F.sum("n")).first()[0] or 0}
    absent = spark.range(clusters).join(lists.select(F.col("ident").cast("long").alias("id")), "id", "left_anti").select(F.format_string("%04d.bin", "id").alias("file"), F.lit("missing").alias("fault"))
    more = lists.filter(F.col("ident") >= clusters).select("file", F.lit(f"beyond the {clusters} clusters").alias("fault"))
    totals = [("manifest.json", f"{chunks} chunks, the clusters hold {sums['chunks']}")] * (sums["chunks"] != chunks) + [("centroids.bin", "missing")] * (not sums["centroids"])
    faults = got.filter("fault IS NOT NULL").select("file", "fault").unionByName(absent).unionByName(more).unionByName(spark.createDataFrame(totals, "file string, fault string"))
    return faults, sums


def sources(spark: SparkSession, path: str) -> DataFrame:
    """doc, sha256 of the texts that the index was built from."""
    raw = json.loads(spark.read.text(f"{path}/sources.json", wholetext=True).first()[0])
    if raw.get("digest") != "sha256" or not isinstance(raw.get("rfcs"), dict):
        raise FormatError("sources.json: not SHA-256 digests")
    return spark.createDataFrame([(str(k), str(v)) for k, v in raw["rfcs"].items()] or [], "doc string, sha256 string")


def tiled(off: np.ndarray, length: np.ndarray, section: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each range, clipped to what no earlier range of its section covers, both at the bounds of lines."""
    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    bound = np.append(feeds + 1, len(raw))
    start = np.concatenate([[0], feeds + 1])[np.searchsorted(feeds, off)]
    end = bound[np.minimum(np.searchsorted(feeds, off + length), len(feeds))]
    order = np.lexsort((length, off, section))
    new = np.append(True, section[order][1:] != section[order][:-1])
    shift = (np.cumsum(new) - 1) * (len(raw) + 1)  # a running maximum that begins anew with each section
    until = np.maximum.accumulate(end[order] + shift) - shift
    covered = np.where(new, 0, np.append(0, until[:-1]))
    start[order] = np.where(covered > off[order], covered, start[order])
    return start, end


def imported(clusters: DataFrame, texts: DataFrame, digests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks with the text of their byte ranges, and the documents left out (doc, why).

    clusters: as of `read_clusters`; texts: doc, content (bytes); digests: doc, sha256. A document whose bytes aren't those
    that the index was built from is left out as a whole, as its ranges describe another text. Chunks of a section don't
    overlap, begin and end with lines, and are numbered in the order of the document; those left without text go.
    """
    have = texts.select("doc", "content", F.sha2("content", 256).alias("_have"))
    if digests is not None:
        have = have.join(digests.select("doc", F.col("sha256").alias("_want")), "doc", "left").withColumn("why", F.when(F.col("_want").isNull(), "unknown to the index").when(F.col("_want") != F.col("_have"), "changed"))
    else:
        have = have.withColumn("why", F.lit(None).cast("string"))
    gone = clusters.select("doc").distinct().join(have.select("doc", F.col("why"), F.lit(True).alias("_is")), "doc", "left")
    gone = gone.filter("_is IS NULL OR why IS NOT NULL").select("doc", F.coalesce("why", F.lit("no text")).alias("why"))
    kinds = dict(clusters.dtypes)
    parts = clusters.groupBy("doc").agg(F.collect_list(F.struct("cluster_id", "off", "len", "section", "title", "code")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content, own in zip(*(batch.column(k) for k in range(3)), strict=True):
                raw, own = content.as_py(), pa.Table.from_struct_array(pa.chunked_array([own.values]))
                off, length = (own[c].to_numpy().astype(np.int64) for c in ("off", "len"))
                name = own["section"].combine_chunks()
                code = name.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                code = np.where(code < 0, len(code), code)  # those without a section share one
                start, end = tiled(np.minimum(off, len(raw)), length, code, raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * len(off), pa.string()), own["cluster_id"].combine_chunks(), pa.array(off), pa.array(start), name, own["title"].combine_chunks(), own["code"].combine_chunks(), pa.array([raw[a:b] for a, b in zip(start, end, strict=True)], pa.binary())],
                    names=["doc", "cluster_id", "off", "start", "section", "title", "code", "bytes"],
                )

    rows = have.filter("why IS NULL").join(parts, "doc").select("doc", "content", "parts")
    rows = rows.mapInArrow(cut, f"doc string, cluster_id int, off long, start long, section string, title string, code {kinds['code']}, bytes binary")
    text = unpaged(F.make_valid_utf8(F.col("bytes").cast("string")))
    rows = rows.withColumn("text", text).filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").drop("bytes")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("off", "start", F.col("section").asc_nulls_last(), "cluster_id")) - 1
    return rows.withColumn("chunk_idx", place), gone
