"""S4a/S4b/S5 against stdlib parsers (brute force)."""

import json
import re
from html.parser import HTMLParser

from docweave.functions.html import html_strip_tags, html_visible_text
from docweave.functions.jsontext import json_pretty, strip_fence

HIDDEN = {"script", "style", "template"}


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.buf, self.open_hidden = [], [], []

    def _flush(self):
        if self.buf:
            if not self.open_hidden:
                self.nodes.append("".join(self.buf))
            self.buf = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in HIDDEN:
            self.open_hidden.append(tag)

    def handle_endtag(self, tag):
        self._flush()
        # an end tag closes the latest open element of that name; one with
        # no open match is ignored (as a tree builder does)
        if tag in self.open_hidden:
            while self.open_hidden.pop() != tag:
                pass

    def handle_startendtag(self, tag, attrs):
        self._flush()

    def handle_data(self, data):
        self.buf.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()


def py_visible(html):
    p = _Visible()
    p.feed(html)
    p.close()
    p._flush()
    return "\n".join(s.strip() for s in p.nodes if s.strip())


CASES = [
    "<p>a &amp; b</p><p>&lt;not a tag&gt;</p>",
    "<div>x<!-- hidden -->y</div>",
    "<html><head><script>var t='</p>';</script><style>p{}</style></head><body>Hi&nbsp;</body></html>",
    '<a title="1 > 0">link</a> tail',
    "<template><p>no</p></template><p>yes</p>",
    "<!DOCTYPE html><p>  spaced   </p><p>   </p>",
    "<P>Upper</P><SCRIPT>x</SCRIPT>done",
    "<img src='" + "A" * 50000 + "'>after",
    "<h1>and&amp</h1><p>&am x &ampy</p>",
]


def test_visible_text_cases(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "h string")
    got = [r.t for r in df.select(html_visible_text("h").alias("t")).collect()]
    assert got == [py_visible(c) for c in CASES]


def test_visible_text_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.select("html", html_visible_text("html").alias("t")).collect():
        assert r.t == py_visible(r.html)


STRIPPED = ["a &amp; b&lt;not a tag&gt;", "xy", "Hi&nbsp;", ' 0">link tail', "noyes", "  spaced      ",
            "Upperdone", "after", "and&amp&am x &ampy"]


def test_strip_tags(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "h string")
    assert [r.t for r in df.select(html_strip_tags("h").alias("t")).collect()] == STRIPPED
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.select("html", html_strip_tags("html").alias("t")).collect():
        assert not re.search("<[a-z/!][^>]*>", r.t, re.IGNORECASE)
        page = iter(r.html)  # what is left stands in the page, in order
        assert all(c in page for c in r.t)


def test_json_pretty_and_errors(spark):
    vals = ['{"name":"Doc","items":[1,2]}', '{"é": "ü", "b": 1.50, "a": null}', "[1, 2", None, '"s"']
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    rows = df.select(json_pretty("v").alias("p")).collect()
    for v, r in zip(vals, rows):
        if v is None:
            assert r.p.text is None and r.p.error is None
            continue
        try:
            want = json.dumps(json.loads(v), indent=2, ensure_ascii=False)
            assert r.p.text == want and r.p.error is None
        except ValueError:
            assert r.p.text is None and r.p.error.startswith("JSONDecodeError")
    assert '"name": "Doc"' in rows[0].p.text and '"items": [' in rows[0].p.text


def test_strip_fence(spark):
    vals = ['```json\n{"a": 1}\n```', '```\n[1]\n```', '{"a": 1}', '```json {"a":1}```', "``` x"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.s for r in df.select(strip_fence("v").alias("s")).collect()]
    assert [g.strip() for g in got] == ['{"a": 1}', "[1]", '{"a": 1}', '{"a":1}', "``` x"]


def test_visible_text_property_on_token_soup(spark):
    """Random markup soup (tags, comments, scripts, templates, entities,
    stray end tags) against the stdlib-parser statement of the rule."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    tokens = st.sampled_from(["<p>", "</p>", "<div class='a'>", "</div>", "<script>", "</script>",
                              "<style>", "</style>", "<!-- c -->", "<br/>", "&amp;", "&lt;", "&gt;",
                              "&nbsp;", "&copy;", " ", "\n", "word", "a", "<b>", "</b>", '<a href="x">',
                              "</a>", "<!DOCTYPE html>", "<template>", "</template>", "&#39;", "&#x41;",
                              "x&y", "é"])

    @settings(max_examples=10, deadline=None, derandomize=True,
              suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(docs=st.lists(st.lists(tokens, max_size=25).map("".join), min_size=1, max_size=40))
    def check(docs):
        df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, h string")
        for r in df.select("id", html_visible_text("h").alias("t")).collect():
            assert r.t == py_visible(docs[r.id]), docs[r.id]

    check()


def test_hidden_elements_at_any_depth_and_without_end_tags(spark):
    cases = {"a" + "<template>" * n + "x" + "</template>" * n + "b": "a\nb" for n in (1, 4, 5, 40)}
    cases |= {"<ruby>x<rt>y</ruby> rest": "x\nrest", "<ruby>x<rp>(<rt>y<rp>)</ruby> rest": "x\nrest",
              "<ruby>x<RT class='>'>y</rt>z</ruby> rest": "x\nz\nrest", "<ruby>a<rt><ruby>b<rt>c</ruby>d</rt>e</ruby>f": "a\ne\nf",
              "a<rt/>b<template />c": "a\nb\nc", "a</ruby>b<template>c</ruby>d": "a\nb", "<template><rt>a</template>b": "b"}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    for r in df.select("h", html_visible_text("h").alias("t")).collect():
        assert r.t == cases[r.h], r.h
