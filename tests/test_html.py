"""Text of pages against a tree that html.parser builds."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from skein import catalogue
from skein.functions import html as H

SF = "/root/testdata/sf0.01"


class Tree(HTMLParser):
    """Nested lists of (name, classes, children) and strings, closed as tags say."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ("", "", [])
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        own = [v or "" for k, v in attrs if k == "class"]
        node = (tag, own[0] if own else "", [])
        self.stack[-1][2].append(node)
        if tag not in H.VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in H.VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.stack[1:]]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def plain(html):
    tree = Tree()
    tree.feed(html or "")
    tree.close()

    def strings(node):
        name, classes, children = node
        if name in H.DROPPED or (name not in H.KEPT_ANYWAY and any(c.startswith(p) for c in classes.split() for p in H.DROPPED_CLASSES)):
            return []
        found = [s for c in children for s in ([c] if isinstance(c, str) else strings(c))]
        return [] if name == "a" and "skip to" in "".join(s.strip() for s in found).lower() else found

    lines = (x.strip() for x in "".join(strings(tree.root)).splitlines())
    return "\n".join(x for x in lines if x and not H.FRAME_LINES.match(x))


FRAGMENTS = [
    '<p title="a>b">x</p>', "<p title='it\"s > so'>y</p>", "a &copy; b &#8212; c &#x2014; &amp;amp; &nbsp;d &unknown; &lt;b&gt;", "1 < 2 and 3 > 2", "a <3 b", "<script>if (a < b) { document.write('<p>no</p>') }</script>yes",
    "<style>p > a { }</style>ok", "<SCRIPT>no</ScRiPt >yes", "<!-- a > b -- <p>no</p> -->yes", "<!DOCTYPE html><p>x", "<?php echo 1 ?>y", "<nav>no<div>no</nav>yes</div>", "<div class='alert-box x'>no <b>no</b></div>yes", '<div class="x  modal">no</div>',
    "<body class=navbar>kept</body>", "<main class='alert'>kept</main>", "<div class=visually-hidden>no</div>z", "<a href='#m'>Skip to main content</a>text", "<a>Skip <b>to</b></a>q", "<a>skip to <i>x", "</p>stray</div>", "<b><i>x</b>y</i>z",
    "<p>one\n\n  two \n<br/>three<br>four</p>", "Privacy Statement\nIANA\n IANA x\nVersion 2.3\nversion of", "<header>no</header><footer/>no<aside>no</aside>x", "<input class=alert>t", "", "   ", "plain", "<div data-class='navbar'>kept</div>",
    "<custom-x a=b c>in</custom-x>", "<p a=1/>x", "<img src='a>b'>i", "x</ >y", "<a href=x>one<a href=y>skip to</a>two</a>three", "ünï <b>çødé</b> 日本",
]


@pytest.mark.parametrize("html", FRAGMENTS)
def test_fragments(html):
    assert H.page_text(html) == plain(html)


def test_all_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in catalogue.QUERIES["html_text"](spark, SF).collect()}
    assert got == {k: plain(v) for k, v in pages.items()} and any("&" in (v or "") for v in pages.values())
    cut = {k: v[: len(v) // 2].rsplit("<", 1)[0] for k, v in pages.items() if v}  # cut off between tags
    assert all(H.page_text(v) == plain(v) for v in cut.values())


def test_blocks_and_issue_lists(spark):
    assert H.page_text("<title>T</title><p>a<b>b</b></p><ul><li>one<li>two</ul>c<br>d") == "Tabonetwocd"
    assert H.page_text("<title>T</title><p>a<b>b</b></p><ul><li>one<li>two</ul>c<br>d", blocks=True) == "T\nab\none\ntwo\nc\nd"
    row = spark.createDataFrame([("a<BR/>b <ul class=x><li> one</li><LI>two </li></ul><b>c</b>", None)], "t string, n string").select(H.listed(F.col("t")), H.listed(F.col("n")), H.page_texts(F.col("n"))).first()
    assert tuple(row) == ("a\nb \n- one\n- two<b>c</b>", None, None)


def test_long_hostile_pages_take_linear_time():
    for unit in ("<a title='", "<", "<!-- ", "</", "<p class=\"x", "&#", "<a><b>"):
        assert isinstance(H.page_text(unit * 20_000 if unit != "<a><b>" else unit * 2_000), str)
    assert re.fullmatch("x*", H.page_text("<p>" * 3000 + "x" + "</p>" * 3000))
