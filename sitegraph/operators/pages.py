"""Crawls without traversal: one page per task, or a given list of pages per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.functions.urls import normalize_url
from sitegraph.operators.crawl import default_hook, elapsed_seconds
from sitegraph.sources.snapshot import fetch, only
from sitegraph.sources.tasks import nonempty_pages

SUMMARY = ["url", "http_status", "title", "content_length", "elapsed_ms"]


def page_summary(pages: DataFrame) -> DataFrame:
    """The record that rides back in a result; html stays behind."""
    extra = [c for c in ("task_id", "error") if c in pages.columns]
    return pages.select(*extra, *SUMMARY)


def page_title(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("page_id", H.title(F.col("html")).alias("title"))


def page_meta(snapshot: DataFrame) -> DataFrame:
    """(page_id, key, value): the last tag of each key.

    The last one is picked inside the page's own array, so nothing is shuffled.
    """
    entries = snapshot.select("page_id", H.meta_entries(F.col("html")).alias("meta"))
    last = F.filter(
        F.transform(
            F.array(*[F.lit(k) for k in H.META_KEYS]),
            lambda k: F.struct(
                k.alias("key"),
                F.try_element_at(F.filter(F.col("meta"), lambda t: t["key"] == k), F.lit(-1))["value"].alias("value"),
            ),
        ),
        lambda t: t["value"].isNotNull(),
    )
    return entries.select("page_id", F.explode(last).alias("tag")).select("page_id", "tag.key", "tag.value")


def meta_last_wins(occurrences: DataFrame) -> DataFrame:
    """Last value per (page_id, key) of rows (page_id, pos, key, value)."""
    return occurrences.groupBy("page_id", "key").agg(F.max_by("value", "pos").alias("value"))


def _asked_for(asked: DataFrame, snapshot: DataFrame) -> DataFrame:
    return only(snapshot, F.col("url"), asked.select(normalize_url(F.col("url")).alias("url")))


def single_pages(tasks: DataFrame, snapshot: DataFrame, unique: bool = False, hook=default_hook) -> DataFrame:
    """The page of each task as fetched, with the hook's verdict."""
    asked = tasks.select(F.col("id").alias("task_id"), "task_type", F.col("payload.url").alias("url"))
    return hook(fetch(asked, _asked_for(asked, snapshot), unique))


def crawl_single(tasks: DataFrame, snapshot: DataFrame, unique: bool = False, hook=default_hook) -> DataFrame:
    """One page per task: summary, meta and whether it was saved; an absent page fails the task."""
    page = single_pages(tasks, snapshot, unique, hook)
    meta = [H.meta_value(F.col("meta"), k).alias(k.replace(":", "_")) for k in H.META_KEYS]
    return page.select(
        "task_id",
        "task_type",
        *SUMMARY,
        "final_url",
        *meta,
        F.when(F.col("outcome") == "saved", 1).otherwise(0).cast("long").alias("pages_saved"),
        "error",
    )


def crawl_pages(tasks: DataFrame, snapshot: DataFrame, unique: bool = False, hook=default_hook) -> DataFrame:
    """The listed pages of each task, order and repeats kept, absent ones as error rows."""
    asked = tasks.select(
        F.col("id").alias("task_id"), F.posexplode(nonempty_pages(F.col("payload.pages"))).alias("pos", "url")
    )
    return hook(fetch(asked, _asked_for(asked, snapshot), unique))


def list_totals(pages: DataFrame) -> DataFrame:
    """Totals of list tasks; "found" are the pages asked for."""
    return (
        pages.groupBy("task_id")
        .agg(
            F.count(F.lit(1)).alias("pages_crawled"),
            F.count_if(F.col("outcome") == "saved").alias("pages_saved"),
            F.count(F.lit(1)).alias("links_found"),
            F.count_if(F.col("error").isNotNull()).alias("errors"),
            F.coalesce(F.sum("elapsed_ms"), F.lit(0)).alias("elapsed_ms"),
        )
        .withColumn("elapsed_seconds", elapsed_seconds(F.col("elapsed_ms")))
    )
