"""Mail and issue archives as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "path string, message_id string, subject string, sender string, date timestamp, in_reply_to string, references array<string>, archived_at string, body string"

COMMENT = "struct<author: string, createdAt: string, body: string>"
ISSUE = f"number long, title string, state string, author string, createdAt string, updatedAt string, closedAt string, labels array<string>, body string, comments array<{COMMENT}>"
REVIEW = f"struct<author: string, state: string, body: string, createdAt: string, updatedAt: string, comments: array<{COMMENT}>>"
PULL = f"{ISSUE}, mergedAt string, mergedBy string, mergeCommit struct<oid: string>, baseRefName string, headRefName string, reviews array<{REVIEW}>"


def parsed(path: str, content: bytes) -> dict:
    """One message; a body of the first plain-text part; null where a header is missing or cannot be read."""
    import email
    from email import policy
    from email.utils import parsedate_to_datetime

    m = email.message_from_bytes(content, policy=policy.default)
    try:
        date = parsedate_to_datetime(str(m["Date"])) if m["Date"] else None
        date = (date if date.tzinfo else date.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None) if date else None
    except (ValueError, TypeError):
        date = None
    part = m.get_body(preferencelist=("plain",))
    ids = lambda h: [x for x in str(m[h] or "").split() if x.startswith("<")]
    return {
        "path": path, "message_id": next(iter(ids("Message-Id")), None), "subject": str(m["Subject"] or ""), "sender": str(m["From"] or ""), "date": date,
        "in_reply_to": next(iter(ids("In-Reply-To")), None), "references": ids("References"), "archived_at": str(m["Archived-At"]).strip("<> ") if m["Archived-At"] else None,
        "body": part.get_content() if part is not None else "",
    }


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """Every .eml below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([parsed(p, bytes(c)) for p, c in zip(f["path"], f["content"], strict=True)], columns=[x.split()[0] for x in MESSAGE.split(", ")])

    return files.select("path", "content").mapInPandas(run, MESSAGE)


def _struct(fields: str) -> str:
    """The fields of a schema as one struct type."""
    out, depth, now = [], 0, ""
    for c in fields + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(now.strip().replace(" ", ": ", 1))
            now = ""
        else:
            now += c
    return f"struct<{', '.join(out)}>"


def read_archives(spark: SparkSession, path: str, pulls: bool = False) -> DataFrame:
    """Issues (or pull requests) of repository archives, one row each.

    Records without a number or title go; their count stays on the row. An archive without the member gives no rows.
    States are in lower case; the date of closing falls back to the last update.
    """
    member = "pulls" if pulls else "issues"
    a = spark.read.option("multiLine", "true").schema(f"repo string, timestamp string, {member} array<{_struct(PULL if pulls else ISSUE)}>").json(path)
    good = F.filter(member, lambda x: x["number"].isNotNull() & x["title"].isNotNull())
    rows = a.select("repo", (F.size(member) - F.size(good)).alias("dropped"), F.explode(good).alias("i"))
    closed = F.when(F.lower("i.state") == "closed", F.coalesce("i.closedAt", "i.updatedAt"))
    more = ["i.mergedAt", "i.mergedBy", "i.mergeCommit", "i.baseRefName", "i.headRefName", "i.reviews"] if pulls else []
    return rows.select("repo", "dropped", "i.number", "i.title", F.lower("i.state").alias("state"), "i.author", "i.createdAt", "i.updatedAt", closed.alias("closedAt"), "i.labels", "i.body", "i.comments", *more)
