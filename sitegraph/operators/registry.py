"""Task types map to handlers; a mixed task table is run by type, failures stay with their task."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.operators.crawl import crawl_totals, default_hook, discover, visit
from sitegraph.operators.pages import crawl_pages, crawl_single, list_totals
from sitegraph.sources.tasks import LIST_TYPES, SINGLE_TYPES, SITE_TYPES, validate_tasks

Handler = Callable[..., DataFrame]

RESULT = ["pages_crawled", "pages_saved", "links_found", "errors", "elapsed_ms"]


def single_result(tasks: DataFrame, snapshot: DataFrame, unique: bool, hook) -> DataFrame:
    failed = F.col("error").isNotNull()
    return crawl_single(tasks, snapshot, unique, hook).select(
        "task_id",
        F.when(failed, 0).otherwise(1).cast("long").alias("pages_crawled"),
        "pages_saved",
        F.lit(None).cast("long").alias("links_found"),
        F.when(failed, 1).otherwise(0).cast("long").alias("errors"),
        F.coalesce(F.col("elapsed_ms"), F.lit(0)).alias("elapsed_ms"),
        "error",
    )


def list_result(tasks: DataFrame, snapshot: DataFrame, unique: bool, hook) -> DataFrame:
    return list_totals(crawl_pages(tasks, snapshot, unique, hook))


def site_result(tasks: DataFrame, snapshot: DataFrame, unique: bool, hook) -> DataFrame:
    starts = tasks.select(
        F.col("id").alias("task_id"), F.col("payload.url").alias("url"), F.col("payload.max_pages").alias("max_pages")
    )
    discovered = discover(starts, snapshot, unique=unique)
    return crawl_totals(visit(discovered, snapshot, unique, hook), discovered)


#: The handler of each built-in task type. A handler takes (tasks, snapshot, unique, hook) and returns one
#: row per task: task_id, the RESULT columns and, for tasks that failed, error.
BUILT_IN: Mapping[str, Handler] = MappingProxyType(
    {
        **dict.fromkeys(SINGLE_TYPES, single_result),
        **dict.fromkeys(LIST_TYPES, list_result),
        **dict.fromkeys(SITE_TYPES, site_result),
    }
)


def execute_tasks(
    tasks: DataFrame,
    snapshot: DataFrame,
    unique: bool = False,
    hook=default_hook,
    handlers: Mapping[str, Handler] | None = None,
) -> DataFrame:
    """One result row per task: task_id, task_type, status, error and the RESULT columns.

    `handlers` adds to the built-in handlers, or replaces some of them.
    """
    table = {**BUILT_IN, **(handlers or {})}
    checked = validate_tasks(tasks, sorted(table))
    valid = checked.where(F.col("status").isNull()).drop("status", "error")
    by_handler: dict[Handler, list[str]] = {}
    for name, fn in sorted(table.items()):
        by_handler.setdefault(fn, []).append(name)

    def run(fn: Handler, names: list[str]) -> DataFrame:
        mine = valid.where(F.col("task_type").isin(*names))
        result = fn(mine, snapshot, unique, hook)
        error = F.col("error") if "error" in result.columns else F.lit(None).cast("string")
        kinds = mine.select(F.col("id").alias("task_id"), "task_type")
        return result.join(kinds, "task_id").select(
            "task_id",
            "task_type",
            F.when(error.isNull(), "succeeded").otherwise("failed").alias("status"),
            error.alias("error"),
            *RESULT,
        )

    none = F.lit(0).cast("long")
    refused = checked.where(F.col("status").isNotNull()).select(
        F.col("id").alias("task_id"),
        "task_type",
        "status",
        "error",
        none.alias("pages_crawled"),
        none.alias("pages_saved"),
        F.lit(None).cast("long").alias("links_found"),
        F.lit(1).cast("long").alias("errors"),
        none.alias("elapsed_ms"),
    )
    return reduce(DataFrame.unionByName, [run(fn, names) for fn, names in by_handler.items()], refused)
