"""Extraction from HTML against hand-written cases and Python's own regex engine."""

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.operators.links import page_hrefs
from sitegraph.operators.pages import page_meta
from sitegraph.sources.snapshot import as_snapshot

TITLES = [
    ("<title></title>", ""),
    ("<svg><title>s</title></svg><title>p</title>", "s"),
    ("<title>x", None),
    ("<title>A &amp; B  </title>", "A &amp; B"),
    ("<TITLE lang='e'>\n two\nlines  </TITLE>", "two\nlines"),
    ("<title>" + " " * 5 + "a" * 299 + " b" + "</title>", "a" * 299 + " "),
    ("<p>none</p>", None),
    (None, None),
]

LINKS = [
    ('<a href="/a#b">', []),
    ('<a href="/x&#38;y">', []),
    ('<a href="">', []),
    ('<a href = "/sp">', []),
    ('<a href="/it\'s">', ["/it"]),
    ('<a data-href="/d">', ["/d"]),
    ("<A HREF='/u'><link href=\"/v\">", ["/u", "/v"]),
]

META = [
    ('<meta name="Description" content="d1">', {"description": "d1"}),
    ('<meta name="keywords" content="a"><meta name="keywords" content="b">', {"keywords": "b"}),
    ('<meta content="x" name="description">', {}),
    ('<meta name="description" content="it\'s">', {"description": "it"}),
    ('<meta name="description" content="">', {"description": ""}),
    ('<meta property="og:title" content="' + "z" * 600 + '">', {"og:title": "z" * 500}),
    ('<meta name="viewport" content="w">', {}),
    ('<meta\n  property="og:site_name"\n  content="n">', {"og:site_name": "n"}),
]


def test_titles(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(TITLES)], "i int, html string")
    got = {r.i: r.t for r in df.select("i", H.title(F.col("html")).alias("t")).collect()}
    for i, (html, want) in enumerate(TITLES):
        assert got[i] == want, html
        found = re.search(r"<title[^>]*>(.*?)</title>", html or "", re.I | re.S)
        assert want == (found.group(1).strip()[:300] if found else None)


def test_hrefs(spark):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(LINKS)], "page_id long, url string, html string")
    rows = page_hrefs(as_snapshot(df)).collect()
    for i, (html, want) in enumerate(LINKS):
        assert [r.href for r in sorted(rows, key=lambda r: r.pos) if r.page_id == i] == want, html


def test_meta_last_wins(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(META)], "page_id long, html string")
    rows = page_meta(df).collect()
    for i, (html, want) in enumerate(META):
        assert {r.key: r.value for r in rows if r.page_id == i} == want, html


@pytest.mark.parametrize("suffix", ["", "&", "&amp;", "&lt", "&copy=2", "&notit;", "&#x41;", "&#65", "&bogus;", "&AMP;x"])
def test_decode_equals_html5(spark, suffix):
    links = [f"/p?a=1&amp;b{suffix}", f"/q{suffix}", "/r", "/s&amp;amp;", "/t&ampb=1"]
    df = spark.createDataFrame([(links,), (["/plain"],)], "hrefs array<string>")
    got = [r[0] for r in df.select(H.decode_hrefs(F.col("hrefs"))).collect()]
    assert sorted(got) == sorted([[unescape(x) for x in links], ["/plain"]])


def test_decode_leaves_python_out_of_plain_pages(spark):
    """Only arrays with other entities than `&amp;` reach the Arrow function as non-NULL."""
    df = spark.createDataFrame([(["/a?x=1&amp;y=2&z=3"],), (["/b&eacute;"],)], "hrefs array<string>")
    hard = F.exists("hrefs", lambda h: ~H._only_amp(h))
    assert [r[0] for r in df.select(hard).collect()] == [False, True]


def test_body_cap_and_media_type(spark):
    df = spark.createDataFrame(
        [("abcdef", "text/html", 3), ("abcdef", None, 3), ("abcdef", "", 3), ("abcdef", "application/pdf", 3), (None, None, 3)],
        "html string, ctype string, n int",
    )
    got = [r[0] for r in df.select(H.body(F.col("html"), F.col("ctype"), 3)).collect()]
    assert got == ["abc", "abc", "abc", "", ""]
