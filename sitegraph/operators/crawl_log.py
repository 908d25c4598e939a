"""From tasks to their whole log: every page with its verdict, and one summary line per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.operators.crawl import default_hook, discover, visit
from sitegraph.operators.logs import page_lines, page_log_union, summary_lines
from sitegraph.operators.pages import crawl_pages, single_pages
from sitegraph.session import cut
from sitegraph.sources.tasks import LIST_TYPES, SINGLE_TYPES, SITE_TYPES, task_ids, validate_tasks

_PAGE = ("task_id", "url", "http_status", "content_length", "title", "elapsed_ms", "error", "outcome", "reason")


def task_pages(valid: DataFrame, snapshot: DataFrame, unique: bool = False, hook=default_hook) -> DataFrame:
    """All pages that valid tasks of the built-in types ask for or reach, with what the hook decided."""
    kind = F.col("task_type")
    single = single_pages(valid.where(kind.isin(*SINGLE_TYPES)), snapshot, unique, hook)
    listed = crawl_pages(valid.where(kind.isin(*LIST_TYPES)), snapshot, unique, hook)
    sites = valid.where(kind.isin(*SITE_TYPES)).select(
        F.col("id").alias("task_id"), F.col("payload.url").alias("url"), F.col("payload.max_pages").alias("max_pages")
    )
    visited = visit(discover(sites, snapshot, unique=unique), snapshot, unique, hook)
    return single.select(*_PAGE).unionByName(listed.select(*_PAGE)).unionByName(visited.select(*_PAGE))


def crawl_log(tasks: DataFrame, snapshot: DataFrame, unique: bool = False, hook=default_hook) -> DataFrame:
    """Log lines of a run of `tasks`: page lines with the task's identity, and `_summary` lines.

    A summary counts the saved, rejected and spooled pages of its task. Refused tasks and single pages
    that are absent have status failed. A hook gives each page an `outcome` (saved, rejected, spooled
    or error; NULL for a page that is not offered) and a `reason`.
    """
    ids = task_ids(tasks)
    checked = validate_tasks(tasks)
    valid = checked.where(F.col("status").isNull()).drop("status", "error")
    pages = cut(task_pages(valid, snapshot, unique, hook))
    lines = page_lines(pages.join(ids, "task_id"))
    totals = pages.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("pages_crawled"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum(F.coalesce("elapsed_ms", F.lit(0))).alias("elapsed_ms"),
    )
    refused = checked.select(F.col("id").alias("task_id"), "status")
    lost = F.col("task_type").isin(*SINGLE_TYPES) & (F.col("errors") > 0)
    status = F.when(F.col("status").isNotNull() | lost, "failed").otherwise("succeeded")
    results = ids.join(refused, "task_id").join(totals, "task_id", "left").withColumn("status", status)
    return page_log_union(lines, summary_lines(results, lines))
