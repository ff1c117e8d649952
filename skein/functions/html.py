"""Pages to text: a scanner of tags, comments, raw elements and character references, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements left out with all they hold, their classes, and lines of a site's frame.
DROPPED = {"script", "style", "nav", "header", "footer", "aside"}
DROPPED_CLASSES = ("navbar", "alert", "modal", "visually-hidden")
KEPT_ANYWAY = {"body", "html", "main"}
FRAME_LINES = re.compile(
    r"(?i)^(?:Privacy Statement|About IETF Datatracker|System Status|Report a bug|IETF LLC|IETF Trust|RFC Editor|IANA|NomComs|Downref registry|Liaison statements)$|^Version \d"
)
#: Elements whose content is text as it stands, and those that have none.
RAW = {"script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

#: Elements that stand on lines of their own, where that is asked for.
BLOCKS = set("address article blockquote br dd div dl dt figcaption figure form h1 h2 h3 h4 h5 h6 hr li main ol p pre section table td th tr ul title".split())

#: What begins at a `<`: a comment, a declaration, an end tag, or a start tag with quoted attributes.
TOKEN = re.compile(r"""<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|<(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*)(?:>|\Z)""", re.S)
CLASS = re.compile(r"""(?i)(?:^|[\s"'/])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are text, start and end; a `<` that begins nothing is text."""
    at = 0
    while at < len(html):
        found = html.find("<", at)
        if found < 0:
            yield "text", unescape(html[at:]), ""
            return
        m = TOKEN.match(html, found)
        if m is None:  # no tag: text up to the next one
            stop = html.find("<", found + 1)
            stop = len(html) if stop < 0 else stop
            yield "text", unescape(html[at:stop]), ""
            at = stop
            continue
        if found > at:
            yield "text", unescape(html[at:found]), ""
        at = m.end()
        if m["name"]:
            name = m["name"].lower()
            yield "start", name, m["attributes"]
            if name in RAW and not m["attributes"].rstrip().endswith("/"):
                close = re.compile(rf"(?i)</{name}\s*>").search(html, at)
                yield "text", html[at : close.start() if close else len(html)], ""
                at = close.start() if close else len(html)
        elif m[0][2:3].isalpha() and m[0].startswith("</"):
            yield "end", re.match(r"</([^\s/>]*)", m[0])[1].lower(), ""


def _hides(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    own = CLASS.search(attributes) if name not in KEPT_ANYWAY and "class" in attributes.lower() else None
    return own is not None and any(c.startswith(DROPPED_CLASSES) for c in unescape(next(x for x in own.groups() if x is not None)).split())


def page_text(html: str | None, blocks: bool = False) -> str:
    """The text of a page as it stands in its source, without blank lines; with `blocks`, elements that are blocks begin and end lines.

    Elements nest as their tags do; an end tag closes the innermost open element of its name and what is open within it, one
    without a start is nothing, and what is never closed ends with the page. Text of hidden elements goes, and links of "skip to".
    """
    out: list[str] = []
    open_: list[tuple[str, bool, int]] = []  # name, whether it hides, where its text begins
    names: Counter[str] = Counter()  # of the open ones
    hidden = 0

    def closed() -> str:
        nonlocal hidden
        name, hides, start = open_.pop()
        hidden -= hides
        names[name] -= 1
        if name == "a" and "skip to" in "".join(x.strip() for x in out[start:]).lower():
            del out[start:]
        return name

    for kind, name, attributes in tokens(html or ""):
        if kind == "text":
            if not hidden:
                out.append(name)
            continue
        if blocks and name in BLOCKS and not hidden:
            out.append("\n")
        if kind == "start" and name not in VOID:
            hides = _hides(name, attributes)
            open_.append((name, hides, len(out)))
            hidden += hides
            names[name] += 1
            if attributes.rstrip().endswith("/"):
                closed()
        elif kind == "end" and names[name]:
            while closed() != name:
                pass
    while open_:
        closed()
    lines = (x.strip() for x in "".join(out).splitlines())
    return "\n".join(x for x in lines if x and not FRAME_LINES.match(x))


def page_texts(html: Column, blocks: bool = False) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: page_text(x, blocks), na_action="ignore")

    return F.pandas_udf(run, "string")(html)


def listed(text: Column) -> Column:
    """The HTML of an issue's text that has a plain form: line breaks and lists; all else stays as it is."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"(?i)<li[^>]*>\s*", "\n- ")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)\s*</li>", ""), r"(?i)</?(?:ul|ol)[^>]*>", "")
