"""Task envelopes: reading, identity columns, type filter and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegraph.schemas import PAYLOAD, TASK

SINGLE_TYPES = ("crawl_single", "crawl_single:meta", "extract_meta")
LIST_TYPES = ("crawl_pages",)
SITE_TYPES = ("crawl_all", "crawl", "crawl_sitemap")
TASK_TYPES = SINGLE_TYPES + LIST_TYPES + SITE_TYPES


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task envelopes; a `max_pages` written as text or with a fraction is read as its whole number."""
    payload = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "max_pages" else f.dataType) for f in PAYLOAD.fields]
    )
    loose = T.StructType([T.StructField(f.name, payload if f.name == "payload" else f.dataType) for f in TASK.fields])
    number = F.expr("try_cast(try_cast(payload.max_pages AS double) AS int)")
    return spark.read.schema(loose).json(path).withColumn("payload", F.col("payload").withField("max_pages", number))


def task_ids(tasks: DataFrame) -> DataFrame:
    """Task and payload flattened to the identity columns every log line carries."""
    p = "payload."
    return tasks.select(
        F.col("id").alias("task_id"),
        "task_type",
        *[F.col(p + n).alias(n) for n in ("client_id", "lead_id", "website_id", "user_id", "redis_job_id")],
        F.col(p + "url").alias("start_url"),
    )


def filter_tasks(
    tasks: DataFrame, pinned: list[str] | None = None, supported: tuple[str, ...] | list[str] = TASK_TYPES
) -> DataFrame:
    """Tasks of the supported and pinned types; a pin that names no supported type is ignored."""
    wanted = F.array(*[F.lit(t.strip()) for t in pinned or [] if t.strip()])
    every = F.array(*[F.lit(t) for t in supported])
    both = F.array_intersect(every, wanted.cast("array<string>"))
    allowed = F.when(F.size(both) > 0, both).otherwise(every)
    return tasks.where(F.array_contains(allowed, F.col("task_type")))


def nonempty_pages(pages):
    """A task's page list without empty entries; a NULL list counts as empty."""
    kept = F.filter(pages, lambda u: u.isNotNull() & (u != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def validate_tasks(tasks: DataFrame, supported: tuple[str, ...] | list[str] = TASK_TYPES) -> DataFrame:
    """Add status ('failed' or NULL) and error. List tasks need pages, other built-in types a URL."""
    # The three messages are part of the results.
    kind = F.col("task_type")
    repr_ = F.coalesce(F.concat(F.lit("'"), kind, F.lit("'")), F.lit("None"))
    no_url = F.coalesce(F.col("payload.url"), F.lit("")) == ""
    error = (
        F.when(
            kind.isNull() | ~kind.isin(*supported), F.concat(F.lit("no handler registered for task_type="), repr_)
        )
        .when(
            kind.isin(*LIST_TYPES) & (F.size(nonempty_pages(F.col("payload.pages"))) == 0),
            "crawl_pages task has no 'pages'",
        )
        .when(kind.isin(*SINGLE_TYPES, *SITE_TYPES) & no_url, "task payload has no 'url'")
    )
    return tasks.withColumn("error", error).withColumn("status", F.when(F.col("error").isNotNull(), "failed"))
