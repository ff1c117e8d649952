"""Leases, pointers and freshness on any Hadoop store."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

POINTER, LEASE = "_current", "_lease"
#: Models whose queries take an instruction, and that instruction.
INSTRUCTED, INSTRUCTION = re.compile(r"(?i)bge-(?:small|base|large)-en"), "Represent this sentence for searching relevant passages: "


class Store:
    """Small files of one folder; a new one is made only if none of its name is there."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def create_once(self, name: str, text: str) -> bool:
        """Whether this call made the file, with its whole text at once; of several at the same time just one does.

        The text is written aside and then moved to its name: by a hard link on a local disk, else by the store's rename,
        which must not replace a file (as HDFS's doesn't).
        """
        aside = f".{name}-{uuid4().hex}"
        self.create(aside, text)
        try:
            if self.fs.getUri().getScheme() == "file":
                here = self.fs.resolvePath(self._path("")).toUri().getPath()
                os.link(f"{here}/{aside}", f"{here}/{name}")
                return True
            return self.fs.rename(self._path(aside), self._path(name))
        except FileExistsError:
            return False
        finally:
            self.fs.delete(self._path(aside), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), False)

    def numbers(self, name: str) -> list[int]:
        """The numbers of all files `name-<number>`, ascending."""
        found = self.fs.globStatus(self._path(f"{name}-*")) or []
        return sorted(int(x) for f in found if (x := f.getPath().getName()[len(name) + 1 :]).isdigit())

    def cell(self, name: str) -> tuple[int, str | None]:
        """The newest value of a name and its number; (0, None) if there never was one."""
        for number in reversed(self.numbers(name)):
            if (text := self.read(f"{name}-{number}")) is not None:
                return number, text
        return 0, None

    def swap(self, name: str, number: int, text: str) -> bool:
        """Compare and set: whether the value became `text`; only if it is still the one of that number."""
        if not self.create_once(f"{name}-{number + 1}", text):
            return False
        if self.numbers(name)[-1] > number + 1:  # made from a number so old that its successors are gone already
            self.delete(f"{name}-{number + 1}")
            return False
        for old in self.numbers(name):
            if old < number:
                self.delete(f"{name}-{old}")
        return True


def acquire(store: Store, owner: str, seconds: float, now: float | None = None, name: str = LEASE) -> bool:
    """Whether `owner` holds the lease now: free, run out, or its own already. Of several that read the same state, one gets it."""
    clock = time.time() if now is None else now
    number, record = store.cell(name)
    if record is not None:
        held = json.loads(record)
        if held["expires_at"] > clock and held["owner"] != owner:
            return False
    return store.swap(name, number, json.dumps({"owner": owner, "acquired_at": clock, "expires_at": clock + seconds}))


def holds(store: Store, owner: str, now: float | None = None, name: str = LEASE) -> bool:
    record = store.cell(name)[1]
    return record is not None and json.loads(record)["owner"] == owner and json.loads(record)["expires_at"] > (time.time() if now is None else now)


def release(store: Store, owner: str, name: str = LEASE) -> None:
    """Ends the owner's own lease; that of another stays."""
    number, record = store.cell(name)
    if record is not None and json.loads(record)["owner"] == owner:
        store.swap(name, number, json.dumps(json.loads(record) | {"expires_at": 0}))


def acquire_slot(store: Store, owner: str, seconds: float, most: int, now: float | None = None) -> int | None:
    """The number of a free slot among `most`, or None."""
    return next((k for k in range(most) if acquire(store, owner, seconds, now, f"_slot{k}")), None)


def pointer(store: Store) -> int | None:
    got = store.cell(POINTER)[1]
    return int(got) if got else None


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], meta: dict[str, str], owner: str, seconds: float = 3600, retain: int = 2) -> int:
    """Stage a version, make sure that the lease still holds, move the pointer unless somebody else moved it, drop old versions."""
    store = Store(spark, root)
    if not acquire(store, owner, seconds):
        raise RuntimeError("another writer holds the lease")
    try:
        was, _ = store.cell(POINTER)
        number = versions.publish(spark, root, tables, meta, retain=0)
        if not holds(store, owner) or not store.swap(POINTER, was, str(number)):
            raise RuntimeError("the lease was lost while staging")
        for old in [v for v in versions.versions(spark, root) if v <= number][:-retain]:
            store.fs.delete(store._path(str(old)), True)
        return number
    finally:
        release(store, owner)


def write_if_changed(store: Store, name: str, text: str) -> bool:
    """Whether the file had other content."""
    old = store.read(name)
    if old is not None and hashlib.sha256(old.encode()).digest() == hashlib.sha256(text.encode()).digest():
        return False
    store.create(name, text)
    return True


def freshness(built: Column, now: Column, least_hours: float) -> Column:
    """`new` if never built, `fresh` within the window, else `due`; a window of 0 or less is off."""
    age = F.unix_timestamp(now) - F.unix_timestamp(built)
    return F.when(built.isNull(), "new").when((F.lit(least_hours) > 0) & (age < least_hours * 3600), "fresh").otherwise("due")


def corpus_kind(group: Column, mailing_list: Column, author: Column, github: Column) -> Column:
    """What a corpus is about: a group, a list, a person's drafts, a repository."""
    return F.when(group.isNotNull(), F.struct(F.lit("group").alias("kind"), group.alias("subject"))).when(mailing_list.isNotNull(), F.struct(F.lit("list").alias("kind"), mailing_list.alias("subject"))).when(author.isNotNull(), F.struct(F.lit("author").alias("kind"), author.alias("subject"))).when(github.isNotNull(), F.struct(F.lit("repository").alias("kind"), github.alias("subject")))


def query_text(model: str, query: str) -> str:
    """A query as its model wants it; texts that are indexed never get the instruction."""
    return (INSTRUCTION if INSTRUCTED.search(model) else "") + query


def install(spark: SparkSession, seed: str, root: str, digests: dict[str, str], owner: str) -> int:
    """Publishes the tables of a seed folder as a version of its own, if each one's digest is the one expected; else nothing changes.

    digests: table name to digest, as `table_digest` gives it.
    """
    tables = {name: spark.read.parquet(f"{seed}/{name}") for name in digests}
    wrong = [name for name, df in tables.items() if table_digest(df) != digests[name]]
    if wrong:
        raise ValueError(f"the seed's tables differ from what was announced: {', '.join(sorted(wrong))}")
    return publish(spark, root, tables, {"seed": seed}, owner)


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: sums of two hashes and the number of rows, which need no sort."""
    a, b = F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)
    row = df.agg(F.count("*"), F.bit_xor(a), F.sum(F.shiftright(b, 20))).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()
