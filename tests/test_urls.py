"""URL rules against hand-written cases and the standard library."""

import random
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from sitegraph.functions import urls as U

CASES = [
    ("http://h/a/b", "../c", "http://h/c"),
    ("http://h/a/b", "//o/x", "http://o/x"),
    ("http://h/a/b", "?q=1", "http://h/a/b?q=1"),
    ("http://h/a/b", "", "http://h/a/b"),
    ("http://h/a/b", "x//y", "http://h/a/x/y"),
    ("http://h/a/b", "/x//y", "http://h/x//y"),
    ("http://h", "r", "http://h/r"),
    ("http://h/a/b", "../../../z", "http://h/z"),
    ("http://h/a/", "./..", "http://h"),
    ("http://h/a", "http:rel", "http://h/rel"),
]

NORMAL = [
    ("http://h/a;jsessionid=1?q=2", "http://h/a?q=2"),
    ("HTTP://H/a", "http://H/a"),
    ("http://h/a/a/?", "http://h/a"),
    ("http://h/en//en", "http://h/en//en"),
    ("http://h/", "http://h"),
    ("http://h/ab/abc", "http://h/ab/abc"),
    ("http://h/ab/ab/abc/abc/abc", "http://h/ab/abc"),
    ("\x01 http://h/x\ty\n", "http://h/xy"),
    ("http://u:p@h:80/x#f", "http://u:p@h:80/x"),
]


def canonical(url):
    """The canonical form written over the standard library."""
    p = urlparse(url)
    segments = p.path.split("/")
    kept = [s for i, s in enumerate(segments) if not s or i == 0 or s != segments[i - 1]]
    text = f"{p.scheme}://{p.netloc}" + "/".join(kept).rstrip("/")
    return text + (f"?{p.query}" if p.query else "")


def test_cases(spark):
    df = spark.createDataFrame(CASES, "base string, href string, want string")
    got = df.select("*", U.normalize_url(U.resolve_url(F.col("base"), F.col("href"))).alias("got")).collect()
    assert all(r.got == r.want for r in got), [r for r in got if r.got != r.want]


def test_normal_form(spark):
    df = spark.createDataFrame(NORMAL, "url string, want string")
    once = U.normalize_url(F.col("url"))
    for r in df.select("*", once.alias("once"), U.normalize_url(once).alias("twice")).collect():
        assert r.once == r.want == r.twice == canonical(r.url)


def test_resolution_equals_standard_library(spark):
    rnd = random.Random(11)
    parts = ["a", "b", "..", ".", "", "x;y", "en", "en", "c d", "ü", "..;p", ".;q", "a.b", ";z", "%20"]

    def path():
        return "/".join(rnd.choice(parts) for _ in range(rnd.randint(0, 5)))

    rows = []
    for _ in range(5000):
        base = rnd.choice(["http://h", "https://H.x:80", "http://u@h"]) + rnd.choice(["", "/", "/" + path()])
        base += rnd.choice(["", "", "?q=1", "?"])
        href = rnd.choice(["", "", "", "/", "//o/", "http:", "https:", "http://h/", "HTTP://h", "mailto:", "ftp://f/", " ", "\t/"])
        href += path() + rnd.choice(["", "", "?z=2", "?", "?a=b;c/d"]) + rnd.choice(["", "", "#f"])
        rows.append((base, href))
    df = spark.createDataFrame(rows, "base string, href string")
    link = F.try_element_at(U.page_links(F.col("base"), F.array("href")), F.lit(1))
    found = df.select("base", "href", U.normalize_url(U.resolve_url(F.col("base"), F.col("href"))).alias("u"), link.alias("l"))
    for r in found.collect():
        want = canonical(urljoin(r.base, r.href).split("#")[0])
        assert r.u == want, r
        if r.l is not None:
            assert (r.l.url, r.l.host) == (want, urlparse(want).netloc), r


def test_link_filters(spark):
    rows = [
        ("/style.CSS?ver=3", False),
        ("/min?f=app.js", False),
        ("/data?x=.json&y", False),
        ("/css_combine?x=1", False),
        ("/feedback", False),
        ("/Feed", True),
        ("/cdn-cgi/l", False),
        ("/pdf", True),
        ("/a.pdf/b", True),
        ("/a.woff2", False),
        (" JavaScript:void(0)", False),
        (" mailto:x@y", False),
        ("mailtox", True),
        ("ftp://h/x", False),
    ]
    df = spark.createDataFrame(rows, "href string, want boolean")
    kept = F.size(U.page_links(F.lit("http://h/"), F.array("href"))) == 1
    got = df.select("href", "want", kept.alias("got")).collect()
    assert all(r.want == r.got for r in got), [r for r in got if r.want != r.got]


def test_parts(spark):
    df = spark.createDataFrame([("HTTPS://User@H:1/p;x/q?a=b|c#f#g",)], "u string")
    row = df.select(U.url_parts(F.col("u")).alias("p"), U.url_fragment(F.col("u")).alias("f")).first()
    assert tuple(row.p) == ("https", "User@H:1", "/p;x/q", "a=b|c") and row.f == "f#g"
