"""Field extraction from HTML text. Patterns only, no DOM: results must match a regex reader."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extraction patterns, meta keys and lengths that define the results.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
META = r"""(?i)<meta[^>]+(?:name|property)=["']([^"']+)["'][^>]+content=["']([^"']*)["']"""
HREF = r"""(?i)href=["']([^"'#]+)["']"""
META_KEYS = ("description", "keywords", "og:title", "og:description", "og:site_name")
TITLE_CHARS = 300
META_CHARS = 500
#: What a live fetch stops at; `body(..., limit=BODY_CHARS)` gives the same text.
BODY_CHARS = 3_000_000

# What str.isspace() accepts, so that stripping agrees with Python.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Entity names the HTML standard accepts without a closing semicolon.
_BARE_NAMES = sorted(name for name in html5 if not name.endswith(";"))
_NEEDS_TABLE = "&(?:#|[A-Za-z][A-Za-z0-9]*;|" + "|".join(_BARE_NAMES) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_html(content_type: Column) -> Column:
    """A missing content type counts as HTML."""
    ctype = F.lower(F.coalesce(content_type, F.lit("")))
    return (ctype == "") | ctype.contains("html")


def body(html: Column, content_type: Column | None = None, limit: int | None = None) -> Column:
    """The text a fetch keeps: nothing for other media types, else all of it, or at most `limit` characters."""
    text = F.coalesce(html, F.lit(""))
    kept = text if limit is None else F.substring(text, 1, limit)
    if content_type is None:
        return kept
    return F.when(is_html(content_type), kept).otherwise(F.lit(""))


def title(html: Column) -> Column:
    """Text of the first title element, undecoded; NULL without one and '' for an empty one."""
    return let(
        F.regexp_extract(html, TITLE, 0),
        lambda e: F.when(e != "", F.substring(strip(F.regexp_extract(e, TITLE, 1)), 1, TITLE_CHARS)),
    )


def meta_entries(html: Column) -> Column:
    """Known meta tags in document order as array<struct<key, value>>; repeats are kept.

    One pass over the page finds the tags; key and value are then matched inside each short tag.
    """
    tags = F.transform(
        F.regexp_extract_all(html, F.lit(META), F.lit(0)),
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, META, 1)).alias("key"),
            F.substring(F.regexp_extract(t, META, 2), 1, META_CHARS).alias("value"),
        ),
    )
    return F.filter(tags, lambda t: t["key"].isin(*META_KEYS))


def meta_value(entries: Column, key: str) -> Column:
    """Value of the last tag named `key`, NULL without one."""
    return F.try_element_at(F.filter(entries, lambda t: t["key"] == key), F.lit(-1))["value"]


def hrefs(html: Column) -> Column:
    """Raw href values in document order."""
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_all(links: pd.Series) -> pd.Series:
    return links.map(lambda page: None if page is None else [unescape(h) for h in page])


def _only_amp(link: Column) -> Column:
    return ~F.replace(link, F.lit("&amp;"), F.lit(" ")).rlike(_NEEDS_TABLE)


def decode_hrefs(links: Column) -> Column:
    """Entity-decode an array of links.

    `&amp;` is the only entity most pages use, and it is decoded in the JVM. A page goes through
    the full HTML5 table in Python only when one of its links may hold another entity; Arrow
    carries a NULL for all other pages.
    """
    hard = F.exists(links, lambda h: ~_only_amp(h))
    decoded = _unescape_all(F.when(hard, links))
    return F.coalesce(decoded, F.transform(links, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&"))))
