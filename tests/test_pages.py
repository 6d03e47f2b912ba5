"""Raw pages read by column functions, against Python's own parser and by hand."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from fathom.functions import html as H
from fathom.operators import pages as P
from fathom.sources.views import table

DATA = "/root/testdata/sf0.001"


class Links(HTMLParser):
    """href and text of links that have one."""

    def __init__(self):
        super().__init__()
        self.found, self.open = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a" and self.open is None:
            self.open = [dict(attrs).get("href"), ""]

    def handle_data(self, data):
        if self.open is not None:
            self.open[1] += data + " "

    def handle_endtag(self, tag):
        if tag == "a" and self.open is not None:
            if self.open[0] is not None:
                self.found.append((self.open[0], " ".join(self.open[1].split())))
            self.open = None


def test_links_are_the_parser_s(spark):
    pages = table(spark, DATA, "firm_pages")
    want = []
    for r in pages.collect():
        p = Links()
        p.feed(r.html)
        want += [(r.page_id, i, *x) for i, x in enumerate(x for x in p.found)]
    got = [(r.page_id, r.href, r.text) for r in P.links(pages).orderBy("page_id", "place").collect()]
    assert got == [(i, href, text) for i, _, href, text in want] and len(got) > 100


def test_odd_markup(spark):
    html = """<HTML lang='de'><title
 id=1> A &amp; B&#39;s &#x41;&#xD800;&#0;&#99999999; &amp;lt; </TITLE><!-- <h1>no</h1> --><script>"<h1>no</h1>"</script><h1><b>One</b>
 two</h1><a
 href = x.html >in <i>one</i></a><a href="">empty</a><a>none</a><a HREF='?q=1'>Q</a><a href="//e.org">E</a><abbr href="no">abbr</abbr><a href="mailto:a@b.c">open"""
    df = spark.createDataFrame([(1, "https://s.com/a/b?x=/y/", html), (2, "https://s.com", None), (3, "https://s.com", "")], "page_id int, url string, html string")
    t = {r.page_id: (r.title, r.heading, r.lang) for r in P.titles(df).collect()}
    assert t == {1: ("A & B's A&#xD800;&#0;&#99999999; &lt;", "One two", "de"), 2: (None, None, None), 3: (None, None, None)}
    got = [(r.place, r.href, r.url, r.text, r.kind) for r in P.links(df).orderBy("place").collect()]
    assert got == [(0, "x.html", "https://s.com/a/x.html", "in one", "homepage"), (1, "", "https://s.com/a/", "empty", "homepage"), (3, "?q=1", "https://s.com/a/b?q=1", "Q", "homepage"), (4, "//e.org", "https://e.org", "E", "homepage")]


@pytest.mark.parametrize("base, href, want", [
    ("https://s.com", "a", "https://s.com/a"), ("https://s.com/", "/a", "https://s.com/a"), ("https://s.com/x/y", "../z", "https://s.com/x/../z"), ("http://s.com/x#f", "#g", "http://s.com/x#g"),
    ("https://s.com/x/", "HTTP://o.org/", "HTTP://o.org/"), ("https://s.com?q=a/b", "c", "https://s.com/c"),
])
def test_absolute(spark, base, href, want):
    df = spark.createDataFrame([(base, href)], "b string, h string")
    assert df.select(H.absolute(F.col("b"), F.col("h")).alias("u")).first().u == want


def test_profiles(spark):
    far = "x" * 400
    html = [
        '<b>Ann Lee</b> <a href="https://www.linkedin.com/in/ann/?s=1">a</a>' + far + '<a href=https://linkedin.com/in/nobody>n</a>' + far + '<img alt="Bob Ray Dow"><a href="http://linkedin.com/in/bob">b</a><a href="https://linkedin.com/in/BOB/">again</a>',
        '<a href="https://linkedin.com/company/one/">1</a><a href="https://linkedin.com/company/two">2</a>', "", None,
    ]
    got = P.profile_links(spark.createDataFrame(list(enumerate(html)), "page_id int, html string")).orderBy("page_id", "kind", "place").collect()
    assert [(r.page_id, r.kind, r.place, r.url, r.name) for r in got] == [
        (0, "person", 0, "https://www.linkedin.com/in/ann", "Ann Lee"), (0, "person", 1, "https://linkedin.com/in/nobody", None), (0, "person", 2, "http://linkedin.com/in/bob", "Bob Ray Dow"), (1, "company", 0, "https://linkedin.com/company/one", None),
    ]
