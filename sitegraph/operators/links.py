"""The ordered out-link table of a page snapshot."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.functions.urls import page_links
from sitegraph.sources.snapshot import keep_first_copies


@cache
def _links_column() -> Column:
    """Built once: the expression is large and does not depend on a table."""
    return page_links(F.col("final_url"), F.col("hrefs"))


def page_hrefs(snapshot: DataFrame, limit: int | None = None) -> DataFrame:
    """Raw href values with their position, one row each, of whole pages or their first `limit` characters."""
    # Exploded as an expression: for a column Spark would infer a filter on its size, and evaluate
    # the pattern over the page a second time.
    html = H.body(F.col("html"), F.col("content_type"), limit)
    return snapshot.select("page_id", F.posexplode(H.hrefs(html)).alias("pos", "href"))


def link_table(snapshot: DataFrame, unique: bool = False, limit: int | None = None) -> DataFrame:
    """(src_url, pos, dst_url, dst_host) of every link worth crawling, any host; html is read once.

    Links are resolved against the page's final URL. The same-host rule depends on the crawl that
    follows a link, so it is an equality on `dst_host` when the table is joined. `limit` reads only so
    many characters of a page.
    """
    found = snapshot.select(
        "page_id",
        "url",
        "final_url",
        H.hrefs(H.body(F.col("html"), F.col("content_type"), limit)).alias("hrefs"),
    )
    decoded = keep_first_copies(found.withColumn("hrefs", H.decode_hrefs(F.col("hrefs"))), snapshot, unique)
    return decoded.select(F.col("url").alias("src_url"), F.explode(_links_column()).alias("link")).select(
        "src_url",
        F.col("link.pos").alias("pos"),
        F.col("link.url").alias("dst_url"),
        F.col("link.host").alias("dst_host"),
    )


def same_host_links(snapshot: DataFrame, hosts: DataFrame, unique: bool = False) -> DataFrame:
    """Links from each page in `hosts(url, host)` to that very host."""
    links = link_table(snapshot, unique)
    return links.join(hosts, (links.src_url == hosts.url) & (links.dst_host == hosts.host)).select(
        "src_url", "pos", "dst_url", "dst_host"
    )
