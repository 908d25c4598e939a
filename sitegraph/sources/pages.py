"""Sinks for crawled pages and the dead-letter table of pages that could not be delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.functions.urls import normalize_url, url_netloc
from sitegraph.schemas import SPOOL

HOST_BUCKETS = 64


def _host_bucket(buckets: int):
    return F.pmod(F.xxhash64(url_netloc(F.col("url"))), F.lit(buckets)).cast("int")


def write_pages(
    visited: DataFrame, snapshot: DataFrame, path: str, buckets: int = HOST_BUCKETS, mode: str = "append"
) -> None:
    """Persist visited pages that have text: metadata per (task, url), html once per URL.

    Hosts are hashed to a fixed number of directories, since hosts may be very many. The rebalance
    hint splits the files of a directory that one large site fills.
    """
    offered = visited.where((F.col("content_length") > 0) & F.col("error").isNull())
    meta = offered.select("task_id", "url", "final_url", "http_status", "title", "content_length", "elapsed_ms")
    meta = meta.withColumn("host", url_netloc(F.col("url"))).withColumn("host_bucket", _host_bucket(buckets))
    meta.hint("rebalance", "host_bucket").write.mode(mode).partitionBy("host_bucket").parquet(f"{path}/meta")
    wanted = offered.select(normalize_url(F.col("url")).alias("url")).distinct()
    html = snapshot.join(wanted, "url", "left_semi").select("url", "html")
    html = html.withColumn("host_bucket", _host_bucket(buckets))
    html.hint("rebalance", "host_bucket").write.mode(mode).partitionBy("host_bucket").parquet(f"{path}/html")


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, html) as written by `write_pages`."""
    return spark.read.parquet(f"{path}/meta"), spark.read.parquet(f"{path}/html")


def write_spool(undelivered: DataFrame, path: str) -> None:
    undelivered.select(*SPOOL.names).write.mode("append").parquet(path)


def read_spool(spark: SparkSession, path: str, json: bool = False) -> DataFrame:
    """The dead-letter table, or a directory of one JSON file per page (unfinished `.tmp` files skipped)."""
    if json:
        return spark.read.schema(SPOOL).option("pathGlobFilter", "*.json").json(path)
    return spark.read.schema(SPOOL).parquet(path)
