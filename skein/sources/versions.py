"""Immutable published versions, retention, exports and compatibility.

A version is a folder of Parquet tables named by its number; a version counts once its marker table is written. All
paths go through Spark's readers and Hadoop's file system, so any store works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_manifest"
COMPAT = ("schema_version", "model", "chunker_version", "dim")


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, oldest first."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    whole = [n for n in names if n.isdigit() and fs.exists(_fs(spark, f"{root}/{n}/{MARKER}/_SUCCESS")[1])]
    return sorted(map(int, whole))


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], meta: dict[str, str], retain: int = 2) -> int:
    """Writes the next version, the marker last, then drops all but the newest `retain` versions."""
    known = versions(spark, root)
    number = (known[-1] if known else 0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{number}/{name}")
    rows = [(k, v) for k, v in sorted((meta | {"build": str(number)}).items())]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{number}/{MARKER}")
    for old in [*known, number][:-retain] if retain > 0 else []:
        fs, path = _fs(spark, f"{root}/{old}")
        fs.delete(path, True)
    return number


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"{root} has no published version")
    return spark.read.parquet(f"{root}/{known[-1]}/{name}")


def metadata(spark: SparkSession, root: str) -> dict[str, str]:
    """Q13 and others: the key and value pairs of the current version, a handful."""
    return {r["key"]: r["value"] for r in current(spark, root, MARKER).collect()}


def compatible(a: dict[str, str], b: dict[str, str]) -> bool:
    """Whether vectors of two indexes may be compared."""
    return all(a.get(k) == b.get(k) for k in COMPAT)


def retained(rows: DataFrame, retain: int) -> DataFrame:
    """X32 as a query: the current version and the next newest. rows: corpus, version, current."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("current"), F.desc("version")))
    return rows.withColumn("_n", n).filter(F.col("_n") <= retain).drop("_n")


def bundles(rows: DataFrame, keys: list[str], order: list[str], text: str = "text", rule: str = "\n\n---\n\n") -> DataFrame:
    """Texts of each bundle joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_text"]), rule).alias("text"), F.count("*").alias("n"))


def write_texts(bundled: DataFrame, keys: list[str], path: str) -> None:
    """One folder a bundle."""
    bundled.select(*keys, "text").write.mode("overwrite").partitionBy(*keys).text(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """X36."""
    hits.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def inventory(files: DataFrame) -> DataFrame:
    """Files and characters of each kind."""
    kind = F.element_at(F.split("relpath", "/"), 1)
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("chars").alias("chars"))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Relpath (below `path`), sha256 and bytes of all files of a folder, of any kind; each is read in the task that hashes it. Spark leaves empty files out."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.expr(f"substring(path, {len(root) + 2})").alias("relpath"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def topics_stale(topics: dict[str, str] | None, index: dict[str, str]) -> bool:
    """K9: whether topics (their metadata, None without any) were made from another build of the index than this one."""
    return topics is None or not topics.get("build") or topics["build"] != index.get("build")
