"""Log records: lines per page, summaries per task, upload batches, receipts and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.operators.delivery import verdict_counts
from sitegraph.operators.progress import rows_in_chunks
from sitegraph.session import hadoop_path, written
from sitegraph.schemas import LOG_LINE

BATCH_RECORDS = 1000
UPLOAD_BUCKETS = 64


def enrich_log(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Attach the task's identity to every page line; which side is broadcast is left to AQE."""
    return lines.join(ids, "task_id")


def _as_log(df: DataFrame) -> DataFrame:
    has = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOG_LINE.fields
        ]
    )


def page_lines(pages: DataFrame) -> DataFrame:
    """Page lines of pages that got a verdict; a failed fetch is logged as `error`.

    The count of characters is stored as `bytes`, as readers of the log expect.
    """
    offered = pages.where(F.col("outcome").isNotNull())
    if "content_length" in offered.columns:
        offered = offered.withColumnRenamed("content_length", "bytes")
    return _as_log(offered.withColumn("kind", F.lit("page")))


def summary_lines(results: DataFrame, log: DataFrame) -> DataFrame:
    """One `_summary` line per task result, with the verdicts counted from its page lines."""
    counts = verdict_counts(log)
    failed = F.col("status") == "failed"
    joined = results.join(counts, "task_id", "left")
    zero = F.lit(0).cast("long")
    return _as_log(
        joined.withColumns(
            {
                "kind": F.lit("_summary"),
                **{o: F.coalesce(F.col(o), zero) for o in ("saved", "rejected", "spooled")},
                "pages_crawled": F.when(failed, 0).otherwise(F.coalesce(F.col("pages_crawled"), zero)),
                "errors": F.when(failed, 1).otherwise(F.coalesce(F.col("errors"), zero)),
                "elapsed_ms": F.when(failed, 0).otherwise(F.coalesce(F.col("elapsed_ms"), zero)),
            }
        )
    )


def page_log_union(lines: DataFrame, summaries: DataFrame) -> DataFrame:
    return lines.unionByName(summaries, allowMissingColumns=True)


def reconcile_log(log: DataFrame) -> DataFrame:
    """Tasks whose summary counts differ from their counted page lines, or lack either."""
    counted = verdict_counts(log.where("kind = 'page'")).select(
        F.col("task_id").alias("_counted"), *[F.col(o).alias(f"counted_{o}") for o in _OUTCOMES]
    )
    claimed = (
        log.where("kind = '_summary'")
        .groupBy(F.col("task_id").alias("_claimed"))
        .agg(*[F.sum(o).alias(f"claimed_{o}") for o in _OUTCOMES])
    )
    both = counted.join(claimed, F.col("_counted").eqNullSafe(F.col("_claimed")), "full_outer")
    differs = ~F.col("counted_saved").eqNullSafe(F.col("claimed_saved"))
    for o in _OUTCOMES[1:]:
        differs = differs | ~F.col(f"counted_{o}").eqNullSafe(F.col(f"claimed_{o}"))
    return both.where(differs).select(
        F.coalesce("_counted", "_claimed").alias("task_id"),
        *[F.col(f"{side}_{o}") for side in ("counted", "claimed") for o in _OUTCOMES],
    )


_OUTCOMES = ("saved", "rejected", "spooled")


def latest_outcome(log: DataFrame, by: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Latest record per (task, url); an aggregate, so copies are folded before the shuffle."""
    keys = ["task_id", "url"]
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return newest.select(*keys, "_r.*")


def rescrape_failed(log: DataFrame, size: int = BATCH_RECORDS, by: tuple[str, ...] = ("ts",)) -> DataFrame:
    """List tasks that retry the pages whose latest outcome is a failure.

    A task with very many failed pages becomes several list tasks of at most `size` pages.
    """
    failed = latest_outcome(log, by).where(F.col("outcome").isin("error", "spooled")).select("task_id", "url")
    chunked = rows_in_chunks(failed, "task_id", ["url"], size)
    listed = chunked.groupBy("task_id", "chunk").agg(F.sort_array(F.collect_list("url")).alias("pages"))
    return listed.select(
        F.concat_ws("#", "task_id", F.col("chunk").cast("string")).alias("id"),
        F.lit("crawl_pages").alias("task_type"),
        F.struct("pages").alias("payload"),
    )


def log_rollup(log: DataFrame) -> DataFrame:
    """Outcomes and bytes per client and lead, per client, and in total."""
    return (
        log.rollup("client_id", "lead_id")
        .agg(
            F.grouping_id().cast("long").alias("level"),
            F.count(F.lit(1)).alias("pages"),
            *[F.count_if(F.col("outcome") == o).alias(o) for o in _OUTCOMES],
            F.sum("bytes").alias("bytes"),
        )
        .select("client_id", "lead_id", "level", "pages", *_OUTCOMES, "bytes")
    )


def failure_rate(results: DataFrame) -> DataFrame:
    """Per website: links found against saved and rejected pages; NULL where nothing was found."""
    sums = results.groupBy("website_id").agg(
        *[F.sum(c).alias(c) for c in ("links_found", "saved", "rejected")]
    )
    found = F.nullif(F.col("links_found"), F.lit(0))
    return sums.withColumns(
        {"saved_rate": F.col("saved") / found, "rejected_rate": F.col("rejected") / found}
    )


def log_batches(log: DataFrame, order: tuple[str, ...] = ("ts", "url"), size: int = BATCH_RECORDS) -> DataFrame:
    """Upload batches per task, at most `size` records each, so that no batch outgrows a row."""
    fields = [c for c in log.columns if c != "task_id"]
    chunked = rows_in_chunks(log, "task_id", list(order), size)
    one = F.struct("pos", *fields)
    return chunked.groupBy("task_id", F.col("chunk").alias("batch")).agg(
        F.count(F.lit(1)).alias("records"), F.sort_array(F.collect_list(one)).alias("lines")
    )


def upload_batches(batches: DataFrame, path: str, buckets: int = UPLOAD_BUCKETS) -> None:
    """Store batches so that uploading a task again replaces all of its earlier batches.

    Tasks are hashed to a fixed number of directories. Only touched directories are rewritten, from
    a copy in the shared folder, because a job must not overwrite what it still reads.
    """
    spark = batches.sparkSession
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int")
    incoming = written(batches.withColumn("task_bucket", bucket), "upload")
    merged = incoming
    target, fs = hadoop_path(spark, path)
    if fs.exists(target):
        old = spark.read.schema(incoming.schema).parquet(path)
        touched = old.join(incoming.select("task_bucket").distinct(), "task_bucket", "left_semi")
        kept = touched.join(incoming.select("task_id").distinct(), "task_id", "left_anti")
        merged = written(kept.unionByName(incoming), "upload")
    (
        merged.hint("rebalance", "task_bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("task_bucket")
        .parquet(path)
    )


def split_acked(files: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acknowledged, left for retry): a file is done once a receipt names its task.

    A file without records has nothing to upload and is done at once.
    """
    empty = F.coalesce(F.col("records"), F.lit(0)) == 0
    done = receipts.select("task_id").distinct()
    uploaded = files.where(~empty)
    acked = uploaded.join(done, "task_id", "left_semi").unionByName(files.where(empty))
    return acked, uploaded.join(done, "task_id", "left_anti")


def upload_totals(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """Tasks and records confirmed by receipts, and files left for retry."""
    sent = files.where("records > 0")
    done = receipts.groupBy("task_id").agg(F.sum("records").alias("confirmed"))
    joined = sent.select("task_id").join(done, "task_id", "left")
    return joined.agg(
        F.count("confirmed").alias("pushed_tasks"),
        F.coalesce(F.sum("confirmed"), F.lit(0)).alias("pushed_records"),
        F.count_if(F.col("confirmed").isNull()).alias("failed"),
    )


def node_liveness(heartbeats: DataFrame, seconds: float, now=None) -> DataFrame:
    """Last heartbeat per node, and whether it is recent; `now` defaults to the latest heartbeat."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    last = heartbeats.groupBy("node").agg(F.max(at).alias("last_us"))
    clock = heartbeats.agg(F.max(at)).scalar() if now is None else F.unix_micros(F.lit(now).cast("timestamp"))
    limit = int(seconds * 1_000_000)
    return last.select("node", "last_us", (clock - F.col("last_us") <= limit).alias("alive"))
