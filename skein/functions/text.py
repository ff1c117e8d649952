"""Text normalisers as native column expressions, with patterns that Java and RE2 read alike where it matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: reply prefixes and list tags before a subject, revisions of a draft's name.
SUBJECT_PREFIX = r"^(?i)(?:\s*(?:(?:re|fwd|fw|aw|sv)\s*:|\[[^\]]*\]))+\s*"
REPLY_PREFIX = r"^(?i)\s*(?:\[[^\]]*\]\s*)*(?:re|fwd|fw|aw|sv)\s*:"
DRAFT_REVISION = r"-\d{2}(?:\.txt)?$"
URL = r"https?://[^\s<>\"')\]]+"
DRAFT_NAME = r"\bdraft-[a-z0-9]+(?:-[a-z0-9]+)+"


def subject(text: Column) -> Column:
    """Without reply prefixes and list tags; a subject of nothing else stays."""
    bare = F.regexp_replace(text, SUBJECT_PREFIX, "")
    return F.when(bare == "", text).otherwise(bare)


def is_reply(text: Column) -> Column:
    """T12."""
    return text.rlike(REPLY_PREFIX)


def sender_name(text: Column) -> Column:
    """The name before the address, without quotes, else the address's local part, else the whole text, else `(unknown)`."""
    name = F.regexp_replace(F.regexp_extract(text, r"^\s*\"?([^\"<]*?)\"?\s*<", 1), r"^\s+|\s+$", "")
    local, bare = F.regexp_extract(text, r"^[\s<]*([^\s<>@]+)@[^\s<>]+>?\s*$", 1), F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(name != "", name).when(local != "", local).when(bare != "", bare).otherwise("(unknown)")


def draft_name(text: Column) -> Column:
    """Lower case, without revision and suffix."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), DRAFT_REVISION, ""), r"\.txt$", "")


def rfc_name(text: Column) -> Column:
    """`rfc 0793`, `RFC793` or `793` to RFC793; null for anything else."""
    number = F.regexp_extract(text, r"(?i)^\s*(?:rfc)?[\s-]*0*([0-9]+)\s*$", 1)
    return F.when(number != "", F.concat(F.lit("RFC"), number))


def canonical_url(url: Column) -> Column:
    """Https, host in lower case without www, no fragment, no slash at the end; the path keeps its case."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^<|>$", ""), r"#.*$", ""), r"[).,;]+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(?i:https?)://([^/?]*)", 1)), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_extract(bare, r"^(?i:https?)://[^/?]*(.*)$", 1), r"/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, rest)).otherwise(bare)


def redacted(text: Column) -> Column:
    """Without the user and password of URLs."""
    return F.regexp_replace(text, r"(https?://)[^/\s:@]+(?::[^/\s@]*)?@", "$1")


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case letters and digits joined by hyphens."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most), r"-+$", "")


def domain_within(domain: Column, wanted: str) -> Column:
    """The domain or one below it."""
    d = F.lower(domain)
    return (d == wanted) | d.endswith("." + wanted)


#: Fixed forms of what a paginated document prints at the foot and the head of its pages.
PAGE_FOOT = r"[^\n]{0,100}\[\s*Page\s+[0-9ivxlcdmIVXLCDM]+\s*\][ \t\r]*"
PAGE_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec"
PAGE_HEAD = rf"(?=[^\n]{{1,100}}$)[^\n]*[ \t][ \t]+(?:{PAGE_MONTH})[ \t]+[0-9]{{4}}[ \t\r]*"
PAGE_BREAK = rf"(?m)^(?:(?:\f*(?:{PAGE_FOOT}|{PAGE_HEAD})|[ \t]*\f[ \t\f]*)(?:\n|\z)(?:[ \t\f]*\n)*|\f+)+"


def unpaged(text: Column) -> Column:
    """Without the feet and heads of pages; a sentence that a page broke is one line again, and the common indent is gone.

    A break becomes a mark first: between a line that ends no sentence and one that begins small it is a space, elsewhere
    nothing. Lines keep their order and their indents relative to each other, as figures need them.
    """
    marked = F.regexp_replace(text, PAGE_BREAK, "\f")
    joined = F.regexp_replace(marked, r"([^\s.:!?;])[ \t\r]*\n\f[ \t]*(?=[\p{Ll},;])", "$1 ")
    lines = F.split(F.replace(joined, F.lit("\f"), F.lit("")), "\n", -1)
    indent = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x))))
    even = F.transform(lines, lambda x: F.regexp_replace(F.substr(x, F.coalesce(indent, F.lit(0)) + 1), r"\s+$", ""))
    return F.regexp_replace(F.array_join(even, "\n"), r"^\n+|\n+$", "")
