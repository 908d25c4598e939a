"""Inputs of the registered queries: the given tables shaped into pages, tasks, logs and pings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.operators.running import number_rows
from sitegraph.session import cut
from sitegraph.sources.snapshot import as_snapshot

_PAGES_PER_BUCKET = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_snapshot(pages(spark, sf_dir))


def site_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, url and rank in its host of each distinct page; narrow, no html."""
    located = pages(spark, sf_dir).select(
        "page_id", F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/+$", "").alias("url")
    )
    first = located.groupBy("url").agg(F.min("page_id").alias("page_id"))
    hosted = first.withColumn("host", F.split(F.split("url", "://")[1], "/")[0])
    bucket = F.floor(F.col("page_id") / _PAGES_PER_BUCKET)
    ranked = number_rows(hosted, ["host"], bucket, [F.col("page_id")], "rnk")
    return cut(ranked.select("page_id", "host", "url", "rnk"))


def site_pages(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> DataFrame:
    """Pages with links to ranks 2r and 2r+1 of their host in front of their own HTML."""
    index = site_index(spark, sf_dir) if index is None else index

    def child(offset: int, label: str, name: str) -> DataFrame:
        text = F.concat(
            F.lit('<a href="'), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(f'">{label}</a>')
        )
        parent = ((F.col("rnk") - offset) / 2).cast("long")
        mine = index.where((F.col("rnk") > 1) & (F.col("rnk") % 2 == offset))
        return mine.select("host", parent.alias("rnk"), text.alias(name))

    linked = index.join(child(0, "l", "_left"), ["host", "rnk"], "left").join(
        child(1, "r", "_right"), ["host", "rnk"], "left"
    )
    empty = F.lit("")
    return linked.join(pages(spark, sf_dir).select("page_id", F.col("html").alias("_own")), "page_id").select(
        "page_id",
        "host",
        "url",
        "rnk",
        F.concat(F.coalesce("_left", empty), F.coalesce("_right", empty), "_own").alias("html"),
    )


def crawl_tasks(index: DataFrame) -> DataFrame:
    """One whole-site task per host, from its first page."""
    size = F.length("host")
    return index.where("rnk = 1").select(
        F.concat(F.lit("crawl:"), "host").alias("task_id"),
        F.when(size % 2 == 0, "crawl_all").otherwise("crawl").alias("task_type"),
        "url",
        F.when(size % 3 == 1, 5).when(size % 3 == 2, 20).alias("max_pages"),
    )


def _pick(n, *values):
    chosen = F.when(n == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        chosen = chosen.when(n == i, value)
    return chosen


def mixed_tasks(index: DataFrame) -> DataFrame:
    """A task per page, of every type and an unknown one; some without URL, pages or ids."""
    n = F.col("page_id")
    gone = F.concat("url", F.lit("/gone"))
    none = F.lit(None).cast("string")

    def ident(prefix: str, mod: int):
        return F.when(n % 11 != 0, F.concat(F.lit(prefix), (n % mod).cast("string")))

    return index.select(
        F.concat(F.lit("task:"), n.cast("string")).alias("id"),
        _pick(
            n % 8,
            *(
                F.lit(t)
                for t in (
                    "crawl_single",
                    "crawl_single:meta",
                    "extract_meta",
                    "crawl_pages",
                    "crawl_all",
                    "crawl_sitemap",
                    "screenshot",
                    "crawl_pages",
                )
            ),
        ).alias("task_type"),
        F.struct(
            F.when(n % 10 == 9, gone).when(n % 10 != 7, F.col("url")).alias("url"),
            F.when(n % 16 == 7, F.array(F.lit("")))
            .otherwise(F.array(F.col("url"), F.lit(""), gone, none, F.col("url")))
            .alias("pages"),
            F.when(n % 4 == 1, 0).when(n % 4 == 2, 3).when(n % 4 == 3, 20).alias("max_pages"),
            ident("c", 7).alias("client_id"),
            ident("l", 31).alias("lead_id"),
            F.concat(F.lit("w"), (n % 13).cast("string")).alias("website_id"),
            F.concat(F.lit("u"), (n % 5).cast("string")).alias("user_id"),
            F.concat(F.lit("r"), n.cast("string")).alias("redis_job_id"),
        ).alias("payload"),
    )


def meta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with meta tags made from their own columns: repeats, other keys, wrong attribute order."""
    key = F.col("page_id").cast("string")
    head = F.concat(
        F.lit('<meta name="Description" content="first '), key, F.lit('"><META property=\'og:title\' content=\''),
        F.col("url"), F.lit('\'><meta name="viewport" content="w"><meta content="no" name="keywords"><meta'),
        F.lit('\n name="description" content="it\'s '), key, F.lit('"><meta property="og:site_name" content="">'),
        F.lit('<meta name="description" content="last '), key, F.lit('">'),
    )
    return pages(spark, sf_dir).select("page_id", "url", F.concat(head, "html").alias("html"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with `ts` as an instant; the table stores UTC wall-clock time without a zone."""
    return in_utc(table(spark, sf_dir, "events"))


def in_utc(e: DataFrame) -> DataFrame:
    return e.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


def _text(prefix: str, value):
    return F.concat(F.lit(prefix), value.cast("string"))


def page_log_of(e: DataFrame) -> DataFrame:
    """Page lines from events; also works on a stream of events."""
    user = F.col("user_id")
    kind = F.col("event_type")
    filed = user % 11 != 0
    return e.select(
        "event_id",
        _text("t", user).alias("task_id"),
        F.when(filed, _text("c", user % 7)).alias("client_id"),
        F.when(filed, _text("l", user % 31)).alias("lead_id"),
        _text("w", user % 13).alias("website_id"),
        F.concat(_text("https://h", user % 7), F.lit(".example.com/"), F.col("event_id").cast("string")).alias("url"),
        F.when(kind == "error", "spooled").when(kind == "signup", "rejected").otherwise("saved").alias("outcome"),
        F.when(kind == "signup", 403).otherwise(200).alias("http_status"),
        F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("long").alias("bytes"),
        "ts",
    )


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_log_of(events(spark, sf_dir))


def repeat_log_of(log: DataFrame) -> DataFrame:
    """The log with only some hundred URLs per task, so that pages are logged again and again."""
    return log.withColumn("url", F.concat(F.lit("https://h.example.com/"), F.col("bytes").cast("string")))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        F.floor(F.col("event_id") / 3).alias("page_key"),
        (F.col("event_id") % 3 + 1).alias("attempt"),
        F.when(kind == "error", "failed").when(kind == "signup", "rejected").otherwise("saved").alias("verdict"),
    )


def spool_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the spool with the error their next delivery meets, or none."""
    n = F.col("event_id")
    return (
        events(spark, sf_dir)
        .where("event_type = 'error'")
        .select(
            n.alias("spool_id"),
            _text("t", F.col("user_id")).alias("task_id"),
            F.unix_micros("ts").alias("spooled_at"),
            _pick(
                n % 4,
                F.lit("409: Task NOT ASSIGNED to this worker"),
                F.lit("404: page"),
                F.lit("request to /page failed: read timed out"),
                F.lit("task not found"),
            ).alias("message"),
        )
    )


def spool_replies(spool: DataFrame) -> DataFrame:
    """Answers to a flush: by thirds saved, refused, or the error message; some quote a misleading 404."""
    n = F.col("spool_id")
    failed = n % 3 == 2
    return spool.where(n % 7 != 6).select(
        "spool_id",
        (~failed).alias("has_reply"),
        (n % 3 == 0).alias("saved"),
        F.when(failed, F.when(n % 5 == 0, "request to /tasks/404/page failed").otherwise(F.col("message"))).alias(
            "message"
        ),
        F.when(failed & (n % 5 == 0), 500).alias("status_code"),
    )


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress pings: the n-th event of a user reports n of all its events."""
    e = events(spark, sf_dir).select("user_id", "event_id", "ts")
    day = F.floor(F.unix_seconds("ts") / 86_400)
    numbered = number_rows(e, ["user_id"], day, [F.col("ts"), F.col("event_id")], "done")
    totals = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return numbered.join(totals, "user_id").select(
        F.col("user_id").cast("string").alias("task_id"), "ts", "done", "total"
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").cast("string").alias("node"), "ts")


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return events(spark, sf_dir).select(
        n.alias("link_id"),
        F.concat(_text("https://h", F.col("user_id") % 7), F.lit(".example.com/a/b")).alias("base_url"),
        _pick(
            n % 10,
            _text("/p/", n),
            F.lit("mailto:x@example.com"),
            _text("/s.CSS?v=", n),
            F.lit("/cdn-cgi/l/email"),
            F.lit("/min?f=app.js"),
            F.lit("/css_combine?x=1"),
            F.concat(_text("../c/", n), F.lit("/")),
            F.lit("https://other.example.org/x"),
            F.concat(_text("/en/en/", n), F.lit("?a=1&amp;b=2")),
            F.lit("/feedback"),
        ).alias("href"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kind = F.col("event_type")
    none = F.lit(None).cast("string")
    return events(spark, sf_dir).select(
        n.alias("fetch_id"),
        F.when(kind == "error", 503).when(kind == "signup", 429).when(kind == "click", 404).otherwise(200).alias(
            "http_status"
        ),
        _pick(
            n % 4, F.lit("text/html; charset=utf-8"), F.lit("application/xhtml+XML"), F.lit("application/pdf"), none
        ).alias("content_type"),
        _pick(
            n % 5, none, F.lit("1.5"), F.lit("120"), F.lit("Wed, 21 Oct 2026 07:28:00 GMT"), F.lit("-3")
        ).alias("retry_after"),
    )
