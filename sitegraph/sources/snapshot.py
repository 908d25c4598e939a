"""Page snapshots: the table that stands in for live fetching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.functions.urls import normalize_url

NOT_FOUND = "not in snapshot"
_HASHED = "hashed"
#: Keys (URLs or hosts, some 100 bytes each) that are broadcast to filter pages before extraction.
MAX_BROADCAST_KEYS = 100_000


def as_snapshot(pages: DataFrame) -> DataFrame:
    """Standard columns from any table with `url` and `html`.

    Missing columns mean a direct 200 answer of unknown type. `page_id`, a unique number, orders
    copies of one URL; without it a hash does, and the column is marked, as equal copies share it.
    """
    has = set(pages.columns)
    copy_key = F.col("page_id") if "page_id" in has else F.xxhash64("url", "html")
    marked = {_HASHED: "page_id" not in has}

    def given(name: str, default, dtype: str):
        return (F.coalesce(F.col(name), default) if name in has else default).cast(dtype).alias(name)

    return pages.select(
        copy_key.cast("long").alias("page_id", metadata=marked),
        normalize_url(F.col("url")).alias("url"),
        given("final_url", F.col("url"), "string"),
        given("http_status", F.lit(200), "int"),
        given("content_type", F.lit(None), "string"),
        given("elapsed_ms", F.lit(0), "long"),
        "html",
    )


def only(snapshot: DataFrame, place: Column, wanted: DataFrame) -> DataFrame:
    """The pages whose `place` is in the one column of `wanted`, found before anything is extracted from them.

    html is not shuffled for it: few wanted values are broadcast, and with more than
    `MAX_BROADCAST_KEYS` all pages stay, since the joins after extraction leave the others out anyway.
    """
    values = wanted.select(F.col(wanted.columns[0]).alias("_wanted")).distinct()
    if values.limit(MAX_BROADCAST_KEYS + 1).count() > MAX_BROADCAST_KEYS:
        return snapshot
    return snapshot.join(F.broadcast(values), place == F.col("_wanted"), "left_semi")


def first_copies(snapshot: DataFrame) -> DataFrame:
    """The page_id kept for each URL; reads no html."""
    return snapshot.groupBy("url").agg(F.min("page_id").alias("page_id"))


def keep_first_copies(extracted: DataFrame, snapshot: DataFrame, unique: bool) -> DataFrame:
    """Drop what was extracted from later copies of a URL.

    Joined after extraction, so that html itself is never shuffled; an inner join, because a
    semi join would be pushed below the extraction.
    """
    if unique:
        return extracted.drop("page_id")
    kept = first_copies(snapshot).select("page_id", F.col("url").alias("_kept_url"))
    joined = extracted.join(kept, "page_id")
    first = joined.where(F.col("url") == F.col("_kept_url")).drop("page_id", "_kept_url")
    return first.dropDuplicates(["url"]) if snapshot.schema["page_id"].metadata.get(_HASHED) else first


def page_facts(snapshot: DataFrame, unique: bool = False, limit: int | None = None) -> DataFrame:
    """One narrow row per URL: everything a crawl reports, without html; of whole pages or their first `limit` characters."""
    html = H.body(F.col("html"), F.col("content_type"), limit)
    facts = snapshot.select(
        "page_id",
        "url",
        "final_url",
        "http_status",
        "elapsed_ms",
        F.length(html).cast("long").alias("content_length"),
        H.title(html).alias("title"),
        H.meta_entries(html).alias("meta"),
    )
    return keep_first_copies(facts, snapshot, unique)


def fetch(
    frontier: DataFrame, snapshot: DataFrame, unique: bool = False, limit: int | None = None
) -> DataFrame:
    """Look up `frontier.url` in the snapshot; an absent URL becomes an error row.

    Facts are extracted before the join, so a URL asked for by very many rows moves only narrow
    columns and AQE may split its partition.
    """
    facts = page_facts(snapshot, unique, limit).withColumnRenamed("url", "_page_url")
    asked = frontier.withColumn("_page_url", normalize_url(F.col("url")))
    hit = asked.join(facts.withColumn("_hit", F.lit(True)), "_page_url", "left").drop("_page_url")
    return hit.withColumn("error", F.when(F.col("_hit").isNull(), F.lit(NOT_FOUND))).drop("_hit")
