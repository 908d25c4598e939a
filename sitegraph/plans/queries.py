"""Registered queries: one per operator, each over the whole given tables, next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sitegraph.functions import delivery as D
from sitegraph.functions import html as H
from sitegraph.functions import urls as U
from sitegraph.functions.paths import slug
from sitegraph.operators import crawl as C
from sitegraph.operators import delivery as DO
from sitegraph.operators import links as L
from sitegraph.operators import logs as G
from sitegraph.operators import pages as P
from sitegraph.operators.crawl_log import crawl_log as log_of_tasks
from sitegraph.operators.progress import throttle_progress
from sitegraph.operators.registry import execute_tasks
from sitegraph.plans import oracles as O
from sitegraph.plans import views as V
from sitegraph.schemas import LOG_LINE
from sitegraph.session import fresh_path, written
from sitegraph.sources import logs as logs_source
from sitegraph.sources import pages as pages_source
from sitegraph.sources import tasks as T
from sitegraph.sources.snapshot import as_snapshot, fetch
from sitegraph.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SIX_HOURS = 6 * 3600
BATCH = 50
LATE_SECONDS = 600


def query(body: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL over the given views."""

    def bind(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if body is not None:
            ORACLES[fn.__name__] = O.sql(body, *views)
        return fn

    return bind


def _sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index = V.site_index(spark, sf_dir)
    return index, as_snapshot(V.site_pages(spark, sf_dir, index))


def _discovered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index, snapshot = _sites(spark, sf_dir)
    return C.discover(V.crawl_tasks(index), snapshot, unique=True), snapshot


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = V.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


# Sources and sinks


@query(
    "SELECT id, task_type, url, CAST(len(list) AS INTEGER) AS listed, max_pages, client_id, lead_id, website_id, "
    "user_id, redis_job_id FROM mixed",
    "mixed",
)
def task_manifest_scan(spark, sf_dir):
    path = fresh_path(spark, "tasks")
    V.mixed_tasks(V.site_index(spark, sf_dir)).write.json(path)
    p = "payload."
    ids = [p + c for c in ("max_pages", "client_id", "lead_id", "website_id", "user_id", "redis_job_id")]
    return T.read_tasks(spark, path).select(
        "id", "task_type", "payload.url", F.size("payload.pages").alias("listed"), *ids
    )


@query(
    """SELECT d.dst_url AS url, CASE WHEN f.page_url IS NOT NULL THEN 200 END AS http_status, f.content_length, f.title,
  CASE WHEN f.page_url IS NULL THEN 'not in snapshot' END AS error
FROM (SELECT DISTINCT dst_url FROM links) d LEFT JOIN facts f ON f.page_url = d.dst_url""",
    "links",
    "facts",
)
def snapshot_fetch(spark, sf_dir):
    _, snapshot = _sites(spark, sf_dir)
    frontier = L.link_table(snapshot, unique=True).select(F.col("dst_url").alias("url")).distinct()
    return fetch(frontier, snapshot, unique=True).select("url", "http_status", "content_length", "title", "error")


@query(
    f"""SELECT task_id, url, {O.part("url", 2)} AS host, title, content_length, content_length AS html_length
FROM crawl_tasks_visited WHERE content_length > 0""",
    "crawl_tasks_visited",
)
def page_sink(spark, sf_dir):
    discovered, snapshot = _discovered(spark, sf_dir)
    path = fresh_path(spark, "pages")
    pages_source.write_pages(C.visit(discovered, snapshot, unique=True), snapshot, path)
    meta, html = pages_source.read_pages(spark, path)
    return meta.join(html.select("url", F.length("html").cast("long").alias("html_length")), "url").select(
        "task_id", "url", "host", "title", "content_length", "html_length"
    )


def _log_lines(log: DataFrame) -> DataFrame:
    """The page log in the schema of a log file."""
    return G.page_lines(log.withColumn("ts", F.unix_seconds("ts")))


@query(
    f"""SELECT {O.slug("client_id")} AS client_dir, {O.slug("lead_id")} AS lead_dir, count(*) AS records,
  CAST(sum(bytes) AS BIGINT) AS bytes, min(ts) AS first_ts FROM (
  SELECT CASE WHEN client_id IS NULL THEN '_unfiled' ELSE client_id END AS client_id,
    CASE WHEN client_id IS NULL THEN website_id ELSE lead_id END AS lead_id, bytes, us // 1000000 AS ts FROM page_log)
GROUP BY ALL""",
    "page_log",
)
def log_sink_jsonl(spark, sf_dir):
    path = fresh_path(spark, "log")
    logs_source.write_log(_log_lines(V.page_log(spark, sf_dir)), path)
    schema = StructType([*LOG_LINE.fields, StructField("client_dir", StringType()), StructField("lead_dir", StringType())])
    back = spark.read.schema(schema).json(path)
    return back.groupBy("client_dir", "lead_dir").agg(
        F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"), F.min("ts").alias("first_ts")
    )


def _write_node_logs(spark: SparkSession, sf_dir: str) -> str:
    """Log files as a node leaves them: valid, blank, broken and scalar lines, and an archive."""
    path = fresh_path(spark, "nodelog")
    filed = logs_source.log_path(_log_lines(V.page_log(spark, sf_dir)))
    valid = F.to_json(F.struct(*LOG_LINE.names))
    broken = F.concat(F.lit('{"task_id": "'), "task_id")
    lines = filed.select(
        "client_dir", "lead_dir", F.explode(F.array(valid, F.lit(""), broken, F.lit("5"))).alias("value")
    )
    lines.write.partitionBy("client_dir", "lead_dir").text(path)
    filed.select(valid.alias("value")).write.text(f"{path}/{logs_source.ARCHIVE}/sent")
    return path


@query("SELECT task_id, client_id, url, outcome, http_status, bytes, us // 1000000 AS ts FROM page_log", "page_log")
def log_scan_jsonl(spark, sf_dir):
    lines = logs_source.read_log(spark, _write_node_logs(spark, sf_dir), suffixes="txt")
    return lines.select("task_id", "client_id", "url", "outcome", "http_status", "bytes", "ts")


def _write_spool(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "spool")
    lost = V.page_log(spark, sf_dir).where("outcome = 'spooled'")
    none = F.lit(None)
    page = F.struct(
        "url",
        F.col("url").alias("final_url"),
        "http_status",
        none.cast("string").alias("title"),
        F.col("bytes").alias("content_length"),
        F.lit(0).cast("long").alias("elapsed_ms"),
        F.concat(F.lit("<p>"), "url").alias("html"),
    )
    rows = lost.select("task_id", F.unix_micros("ts").alias("spooled_at"), page.alias("page"))
    pages_source.write_spool(rows, path)
    return path


@query(
    "SELECT task_id, url, us AS spooled_at, bytes AS content_length, '<p>' || url AS html FROM page_log "
    "WHERE outcome = 'spooled'",
    "page_log",
)
def spool_sink_scan(spark, sf_dir):
    spool = pages_source.read_spool(spark, _write_spool(spark, sf_dir))
    return spool.select("task_id", "page.url", "spooled_at", "page.content_length", "page.html")


@query(
    f"""SELECT task_id, (n - 1) // {BATCH} AS batch, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes,
  arg_min(url, n) AS first_url FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY us, url) AS n FROM page_log) GROUP BY ALL""",
    "page_log",
)
def log_batch_upload(spark, sf_dir):
    log = V.page_log(spark, sf_dir).select("task_id", F.unix_micros("ts").alias("ts"), "url", "outcome", "bytes")
    path = fresh_path(spark, "uploaded")
    batches = written(G.log_batches(log, size=BATCH), "batches")
    G.upload_batches(batches, path, buckets=16)
    # The same tasks again: nothing is stored twice.
    G.upload_batches(batches, path, buckets=16)
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + x["bytes"])
    return spark.read.parquet(path).select(
        "task_id", "batch", "records", total.alias("bytes"), F.col("lines")[0]["url"].alias("first_url")
    )


def _log_files(log: DataFrame) -> DataFrame:
    """Records per task file; every 17th user's file has only blank lines."""
    user = F.substring_index("task_id", "t", -1).cast("long")
    kept = F.count_if(user % 17 != 0)
    return log.groupBy("task_id").agg(kept.alias("records"))


def _receipts(files: DataFrame) -> DataFrame:
    user = F.substring_index("task_id", "t", -1).cast("long")
    return files.where((user % 5 != 0) & (F.col("records") > 0))


_FILES = """(SELECT task_id, u, CASE WHEN u % 17 = 0 THEN 0 ELSE n END AS records FROM (
  SELECT task_id, CAST(substr(task_id, 2) AS BIGINT) AS u, count(*) AS n FROM page_log GROUP BY task_id))"""


@query(
    f"SELECT task_id, records, CASE WHEN records = 0 OR u % 5 <> 0 THEN 'acknowledged' ELSE 'retry' END AS action "
    f"FROM {_FILES}",
    "page_log",
)
def log_ack_retention(spark, sf_dir):
    files = _log_files(V.page_log(spark, sf_dir))
    acked, left = G.split_acked(files, _receipts(files))
    return acked.withColumn("action", F.lit("acknowledged")).unionByName(left.withColumn("action", F.lit("retry")))


# Projections and scalar rules


@query(f"SELECT page_id, {O.title('html')} AS title FROM pages")
def page_title(spark, sf_dir):
    return P.page_title(V.pages(spark, sf_dir))


@query(
    f"SELECT page_id, key, arg_max(value, pos) AS value FROM meta_tags WHERE key IN ({O.quoted(O.META_KEYS)}) "
    "GROUP BY page_id, key",
    "meta_tags",
)
def page_meta(spark, sf_dir):
    return P.page_meta(V.meta_pages(spark, sf_dir))


@query(
    f"SELECT page_id, CAST(generate_subscripts(hs, 1) - 1 AS INTEGER) AS pos, unnest(hs) AS href FROM "
    f"(SELECT page_id, regexp_extract_all(html, '{O.HREF}', 1) AS hs FROM pages)"
)
def page_hrefs(spark, sf_dir):
    return L.page_hrefs(V.snapshot(spark, sf_dir))


@query(
    "SELECT src_url, CAST(pos AS INTEGER) AS pos, replace(href, '&amp;', '&') AS href FROM hrefs",
    "hrefs",
)
def href_entity_decode(spark, sf_dir):
    _, snapshot = _sites(spark, sf_dir)
    found = snapshot.select(F.col("url").alias("src_url"), H.hrefs(F.col("html")).alias("hrefs"))
    return found.withColumn("hrefs", H.decode_hrefs(F.col("hrefs"))).select(
        "src_url", F.posexplode("hrefs").alias("pos", "href")
    )


@query(
    f"SELECT page_id, {O.part('url', 1)} AS scheme, {O.part('url', 2)} AS netloc, {O.part('url', 3)} AS path, "
    f"{O.part('url', 4)} AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages"
)
def url_split(spark, sf_dir):
    url = F.col("url")
    parts = V.pages(spark, sf_dir).select("page_id", U.url_parts(url).alias("p"), U.url_fragment(url).alias("fragment"))
    return parts.select("page_id", "p.*", "fragment")


def _decoded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.raw_links(spark, sf_dir)
    return raw.withColumn("decoded", H.decode_hrefs(F.array("href"))[0])


@query(
    f"SELECT link_id, {O.resolve('base_url', 'h')} AS url FROM (SELECT *, replace(href, '&amp;', '&') AS h FROM raw_links)",
    "raw_links",
)
def url_resolve(spark, sf_dir):
    links = _decoded_links(spark, sf_dir)
    return links.select("link_id", U.resolve_url(F.col("base_url"), F.col("decoded")).alias("url"))


@query(
    f"SELECT 'page' AS kind, page_id AS id, {O.normal('url')} AS url FROM pages UNION ALL "
    f"SELECT 'link', link_id, {O.normal('u')} FROM (SELECT link_id, base_url || '/' || ltrim(href, './') || '//' AS u "
    "FROM raw_links)",
    "raw_links",
)
def url_normalize(spark, sf_dir):
    joined = F.concat("base_url", F.lit("/"), F.ltrim("href", F.lit("./")), F.lit("//"))
    links = V.raw_links(spark, sf_dir).select(F.lit("link").alias("kind"), F.col("link_id").alias("id"), joined.alias("u"))
    pages = V.pages(spark, sf_dir).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("u"))
    return pages.unionByName(links).select("kind", "id", U.normalize_url(F.col("u")).alias("url"))


@query(
    "SELECT page_url AS url, 200 AS http_status, title, content_length, CAST(0 AS BIGINT) AS elapsed_ms FROM facts",
    "facts",
)
def page_summary(spark, sf_dir):
    _, snapshot = _sites(spark, sf_dir)
    index = snapshot.select("url")
    return P.page_summary(fetch(index, snapshot, unique=True)).drop("error")


@query("SELECT page_id, length(left(html, 3000000)) AS content_length, length(html) > 3000000 AS cut FROM pages")
def content_length_cap(spark, sf_dir):
    html = F.col("html")
    kept = F.length(H.body(html, limit=H.BODY_CHARS)).cast("long")
    return V.pages(spark, sf_dir).select("page_id", kept.alias("content_length"), (F.length(html) > kept).alias("cut"))


@query(
    "SELECT fetch_id, coalesce(content_type, '') = '' OR contains(lower(content_type), 'html') AS is_html FROM responses",
    "responses",
)
def is_html(spark, sf_dir):
    return V.responses(spark, sf_dir).select("fetch_id", H.is_html(F.col("content_type")).alias("is_html"))


@query(
    "SELECT fetch_id, CASE WHEN w IS NULL THEN 2.0::DOUBLE WHEN w < 0 THEN 0.0 WHEN w > 8 THEN 8.0 ELSE w END AS "
    "wait_seconds FROM (SELECT fetch_id, try_cast(retry_after AS DOUBLE) AS w FROM responses)",
    "responses",
)
def retry_wait_seconds(spark, sf_dir):
    return V.responses(spark, sf_dir).select("fetch_id", D.retry_wait(F.col("retry_after")).alias("wait_seconds"))


@query(f"SELECT page_id, {O.slug('url')} AS url_slug, {O.slug('t')} AS title_slug FROM "
       f"(SELECT page_id, url, {O.title('html')} AS t FROM pages)")
def path_slug(spark, sf_dir):
    titles = V.pages(spark, sf_dir).select("page_id", "url", H.title(F.col("html")).alias("t"))
    return titles.select("page_id", slug(F.col("url")).alias("url_slug"), slug(F.col("t")).alias("title_slug"))


_PATH = f"""CASE WHEN client_id IS NULL THEN '_unfiled/' || {O.slug("website_id")}
  ELSE {O.slug("client_id")} || '/' || {O.slug("lead_id")} END || '/' || {O.slug("task_id")} || '.jsonl'"""


@query(f"SELECT event_id, {_PATH} AS path FROM page_log", "page_log")
def log_path_key(spark, sf_dir):
    log = V.page_log(spark, sf_dir).withColumn("user_id", F.lit(None).cast("string"))
    return logs_source.log_path(log).select("event_id", F.concat_ws("/", "client_dir", "lead_dir", "file").alias("path"))


@query(
    "SELECT id AS task_id, task_type, client_id, lead_id, website_id, user_id, redis_job_id, url AS start_url FROM mixed",
    "mixed",
)
def task_ids(spark, sf_dir):
    return T.task_ids(V.mixed_tasks(V.site_index(spark, sf_dir)))


@query(
    "SELECT spool_id, CASE WHEN spool_id % 3 = 1 THEN 'rejected' ELSE 'saved' END AS verdict FROM spool "
    "WHERE spool_id % 7 <> 6",
    "spool",
)
def server_verdict(spark, sf_dir):
    replies = V.spool_replies(V.spool_errors(spark, sf_dir))
    return replies.select("spool_id", D.server_verdict(F.col("has_reply"), F.col("saved")).alias("verdict"))


@query("SELECT event_id, (bytes * 37 + 5) // 10 / 100.0::DOUBLE AS seconds FROM page_log", "page_log")
def elapsed_seconds(spark, sf_dir):
    return V.page_log(spark, sf_dir).select("event_id", C.elapsed_seconds(F.col("bytes") * 37).alias("seconds"))


@query("SELECT id, CASE WHEN coalesce(max_pages, 0) = 0 THEN 50 ELSE max_pages END AS max_pages FROM mixed", "mixed")
def task_defaults(spark, sf_dir):
    tasks = V.mixed_tasks(V.site_index(spark, sf_dir))
    return tasks.select("id", C.crawl_budget(F.col("payload.max_pages")).alias("max_pages"))


# Filters


@query(f"SELECT link_id, href FROM raw_links WHERE NOT {O.pseudo('href')}", "raw_links")
def drop_pseudo_links(spark, sf_dir):
    return V.raw_links(spark, sf_dir).select("link_id", "href").where(~U.is_pseudo_link(F.col("href")))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made absolute, with their parts; written once, since filters would repeat the work."""
    links = _decoded_links(spark, sf_dir).where(~U.is_pseudo_link(F.col("decoded")))
    found = links.select(
        "link_id",
        U.url_netloc(F.col("base_url")).alias("host"),
        U.normalize_url(U.resolve_url(F.col("base_url"), F.col("decoded"))).alias("url"),
    )
    return written(found.withColumn("p", U.url_parts(F.col("url"))), "located")


@query(
    f"SELECT link_id, url FROM raw_located WHERE {O.part('url', 1)} IN ('http', 'https') "
    f"AND {O.part('url', 2)} = {O.part('base_url', 2)}",
    "raw_located",
)
def http_same_host(spark, sf_dir):
    same = F.col("p.scheme").isin(*U.PAGE_SCHEMES) & (F.col("p.netloc") == F.col("host"))
    return _located(spark, sf_dir).where(same).select("link_id", "url")


@query(f"SELECT link_id, url FROM raw_located WHERE NOT {O.asset_path('url')}", "raw_located")
def skip_asset_path(spark, sf_dir):
    return _located(spark, sf_dir).where(~U.is_asset_path(F.col("p.path"))).select("link_id", "url")


@query(f"SELECT link_id, url FROM raw_located WHERE NOT {O.infra_path('url')}", "raw_located")
def skip_infra_prefix(spark, sf_dir):
    return _located(spark, sf_dir).where(~U.is_infra_path(F.col("p.path"))).select("link_id", "url")


@query(f"SELECT link_id, url FROM raw_located WHERE NOT {O.asset_hint('url')}", "raw_located")
def skip_asset_hint(spark, sf_dir):
    return _located(spark, sf_dir).where(~U.has_asset_hint(F.col("url"))).select("link_id", "url")


@query(f"SELECT link_id, url FROM raw_located WHERE NOT {O.asset_query('url')}", "raw_located")
def skip_asset_query(spark, sf_dir):
    return _located(spark, sf_dir).where(~U.has_asset_query(F.col("p.query"))).select("link_id", "url")


@query("SELECT id, task_type FROM mixed WHERE task_type IN ('crawl_single', 'crawl_all')", "mixed")
def task_type_filter(spark, sf_dir):
    tasks = V.mixed_tasks(V.site_index(spark, sf_dir))
    return T.filter_tasks(tasks, ["crawl_all", " crawl_single ", "unknown"]).select("id", "task_type")


@query("SELECT id, task_type, CASE WHEN error IS NOT NULL THEN 'failed' END AS status, error FROM checked", "checked")
def task_validation(spark, sf_dir):
    tasks = V.mixed_tasks(V.site_index(spark, sf_dir))
    return T.validate_tasks(tasks).select("id", "task_type", "status", "error")


@query(
    """SELECT fetch_id, CASE WHEN http_status IN (429, 503) AND fetch_id % 3 = 0 THEN 200
  WHEN http_status IN (429, 503) AND fetch_id % 3 = 1 THEN 503 ELSE http_status END AS http_status,
  http_status IN (429, 503) AND fetch_id % 3 < 2 AS retried FROM responses""",
    "responses",
)
def retryable_status(spark, sf_dir):
    first = V.responses(spark, sf_dir).select("fetch_id", "http_status", F.lit(1).alias("attempt"))
    again = first.where("fetch_id % 3 < 2").selectExpr(
        "fetch_id", "CASE fetch_id % 3 WHEN 0 THEN 200 ELSE 503 END AS http_status", "2 AS attempt"
    )
    return DO.final_response(first.unionByName(again))


@query(
    """SELECT spool_id, CASE WHEN regexp_matches(lower(message), 'not assigned|not found|404') THEN 'dropped' ELSE 'keep' END
  AS action FROM spool""",
    "spool",
)
def dead_letter_class(spark, sf_dir):
    return V.spool_errors(spark, sf_dir).select("spool_id", D.dead_letter_class(F.col("message")).alias("action"))


_LISTED = """(SELECT id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS url FROM (
  SELECT id, list_filter(list, lambda u: u IS NOT NULL AND u <> '') AS l FROM {0}))"""


@query(f"SELECT * FROM {_LISTED.format('mixed')}", "mixed")
def nonempty_page_list(spark, sf_dir):
    tasks = V.mixed_tasks(V.site_index(spark, sf_dir))
    return tasks.select("id", F.posexplode(T.nonempty_pages(F.col("payload.pages"))).alias("pos", "url"))


@query(
    f"SELECT src_url, CAST(pos AS INTEGER) AS pos, dst_url, dst_host FROM links WHERE dst_host = {O.part('src_url', 2)}",
    "links",
)
def same_host_links(spark, sf_dir):
    index, snapshot = _sites(spark, sf_dir)
    return L.same_host_links(snapshot, index.select("url", "host"), unique=True)


# Joins


def _valid_tasks(index: DataFrame, types: tuple[str, ...]) -> DataFrame:
    checked = T.validate_tasks(V.mixed_tasks(index))
    return checked.where(F.col("status").isNull() & F.col("task_type").isin(*types)).drop("status", "error")


@query(
    """SELECT c.id AS task_id, c.task_type, c.url, f.title, f.content_length, CAST(NULL AS VARCHAR) AS description,
  CASE WHEN f.content_length > 0 THEN 1 ELSE 0 END::BIGINT AS pages_saved,
  CASE WHEN f.page_url IS NULL THEN 'not in snapshot' END AS error
FROM checked c LEFT JOIN facts f ON f.page_url = c.url
WHERE c.error IS NULL AND c.task_type IN ('crawl_single', 'crawl_single:meta', 'extract_meta')""",
    "checked",
    "facts",
)
def crawl_single(spark, sf_dir):
    index, snapshot = _sites(spark, sf_dir)
    pages = P.crawl_single(_valid_tasks(index, T.SINGLE_TYPES), snapshot, unique=True)
    return pages.select(
        "task_id", "task_type", "url", "title", "content_length", "description", "pages_saved", "error"
    )


_LIST_PAGES = f"""SELECT l.id AS task_id, l.pos, l.url, f.title, f.content_length,
  CASE WHEN f.page_url IS NULL THEN 'not in snapshot' END AS error
FROM {_LISTED.format("(SELECT * FROM checked WHERE error IS NULL AND task_type = 'crawl_pages')")} l
LEFT JOIN facts f ON f.page_url = l.url"""


@query(_LIST_PAGES, "checked", "facts")
def crawl_pages(spark, sf_dir):
    index, snapshot = _sites(spark, sf_dir)
    pages = P.crawl_pages(_valid_tasks(index, T.LIST_TYPES), snapshot, unique=True)
    return pages.select("task_id", "pos", "url", "title", "content_length", "error")


@query(
    """SELECT DISTINCT f.task_id, l.dst_url AS url FROM crawl_tasks_found f JOIN links l ON l.src_url = f.url
  AND l.dst_host = regexp_extract(f.url, '://([^/?]*)', 1)
WHERE f.visited AND NOT EXISTS (SELECT 1 FROM crawl_tasks_found s WHERE s.visited AND s.task_id = f.task_id
  AND s.url = l.dst_url)""",
    "crawl_tasks_found",
    "links",
)
def frontier_minus_seen(spark, sf_dir):
    candidates, seen = _candidates(spark, sf_dir)
    new = C.frontier_minus_seen(candidates.select("task_id", "url"), seen, ["task_id", "url"])
    return new.distinct()


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Same-host links of all visited pages with the rank of their page, and those pages."""
    discovered, snapshot = _discovered(spark, sf_dir)
    seen = discovered.where("visited").select("task_id", "url", "rank")
    links = L.link_table(snapshot, unique=True)
    pages = seen.select("task_id", "rank", F.col("url").alias("src_url"), U.url_netloc(F.col("url")).alias("dst_host"))
    found = pages.join(links, ["src_url", "dst_host"])
    return found.selectExpr("task_id", "dst_url AS url", "rank AS parent_rank", "pos"), seen


@query(
    """SELECT task_id, url, 'crawl_pages' AS task_type FROM latest WHERE outcome = 'spooled'""",
    "latest",
)
def rescrape_failed(spark, sf_dir):
    log = V.repeat_log_of(V.page_log(spark, sf_dir))
    tasks = G.rescrape_failed(log, by=("ts", "event_id"))
    return tasks.select(
        F.substring_index("id", "#", 1).alias("task_id"), F.explode("payload.pages").alias("url"), "task_type"
    )


_COUNTS = """(SELECT task_id, CAST(substr(task_id, 2) AS BIGINT) AS u, count(*) FILTER (outcome = 'saved') AS saved,
  count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'spooled') AS spooled
  FROM page_log GROUP BY task_id)"""


@query(
    f"""SELECT task_id, saved AS counted_saved, rejected AS counted_rejected, spooled AS counted_spooled,
  CASE WHEN u % 7 <> 0 THEN saved + 1 END AS claimed_saved, CASE WHEN u % 7 <> 0 THEN rejected END AS claimed_rejected,
  CASE WHEN u % 7 <> 0 THEN spooled END AS claimed_spooled FROM {_COUNTS} WHERE u % 5 = 0 OR u % 7 = 0""".replace(
        "saved + 1", "saved + CASE WHEN u % 5 = 0 THEN 1 ELSE 0 END"
    ),
    "page_log",
)
def log_reconcile(spark, sf_dir):
    lines = _log_lines(V.page_log(spark, sf_dir))
    user = F.substring_index("task_id", "t", -1).cast("long")
    claimed = DO.verdict_counts(lines).where(user % 7 != 0)
    claimed = claimed.withColumn("saved", F.col("saved") + F.when(user % 5 == 0, 1).otherwise(0))
    return G.reconcile_log(G.page_log_union(lines, claimed.withColumn("kind", F.lit("_summary"))))


@query(
    """SELECT p.event_id, p.task_id, p.url, p.outcome, t.client_id, t.website_id, t.start_url FROM page_log p JOIN (
  SELECT task_id, min(client_id) AS client_id, min(website_id) AS website_id, min(url) AS start_url FROM page_log
  GROUP BY task_id) t USING (task_id)""",
    "page_log",
)
def log_task_enrich(spark, sf_dir):
    log = V.page_log(spark, sf_dir)
    ids = log.groupBy("task_id").agg(
        F.min("client_id").alias("client_id"), F.min("website_id").alias("website_id"), F.min("url").alias("start_url")
    )
    return G.enrich_log(log.select("event_id", "task_id", "url", "outcome"), ids).select(
        "event_id", "task_id", "url", "outcome", "client_id", "website_id", "start_url"
    )


# Aggregations


@query("SELECT * FROM crawl_tasks_totals", "crawl_tasks_totals")
def crawl_totals(spark, sf_dir):
    discovered, snapshot = _discovered(spark, sf_dir)
    return C.crawl_totals(C.visit(discovered, snapshot, unique=True), discovered)


@query(f"SELECT task_id, saved, rejected, spooled FROM {_COUNTS}", "page_log")
def verdict_counts(spark, sf_dir):
    return DO.verdict_counts(V.page_log(spark, sf_dir))


@query("SELECT task_id, count(DISTINCT url) AS links_found FROM crawl_tasks_found GROUP BY task_id", "crawl_tasks_found")
def distinct_links(spark, sf_dir):
    return C.distinct_links(_discovered(spark, sf_dir)[0])


@query(
    """SELECT page_key, coalesce(v, 'spooled') AS outcome, d AS deciding_attempt,
  coalesce((SELECT sum(0.5 * pow(2, b.attempt - 1)) FROM attempts b WHERE b.page_key = p.page_key AND b.verdict = 'failed'
    AND b.attempt < coalesce(d, 3)), 0)::DOUBLE AS backoff_seconds
FROM (SELECT page_key, min(attempt) FILTER (verdict <> 'failed') AS d,
  arg_min(verdict, attempt) FILTER (verdict <> 'failed') AS v FROM attempts GROUP BY page_key) p""",
    "attempts",
)
def attempt_fold(spark, sf_dir):
    return DO.fold_attempts(V.attempts(spark, sf_dir))


_FLUSH_TOTALS = "SELECT " + ", ".join(
    f"count(*) FILTER (flush_outcome = '{o}') AS {o}" for o in ("recovered", "rejected", "dropped", "remaining")
)


@query(f"{_FLUSH_TOTALS} FROM flushed", "flushed")
def spool_flush_totals(spark, sf_dir):
    spool = V.spool_errors(spark, sf_dir).drop("message")
    replies = V.spool_replies(V.spool_errors(spark, sf_dir))
    return DO.flush_totals(DO.flush_spool(spool, replies, limit=None))


_SUMMARY = f"""SELECT task_id, '_summary' AS kind, CASE WHEN u % 9 = 0 THEN 'failed' ELSE 'succeeded' END AS status, saved,
  rejected, spooled, CASE WHEN u % 9 = 0 THEN 0 ELSE saved + rejected + spooled END AS pages_crawled,
  CASE WHEN u % 9 = 0 THEN 1 ELSE 0 END::BIGINT AS errors, CASE WHEN u % 9 = 0 THEN 0 ELSE us END AS elapsed_ms
FROM {_COUNTS} JOIN (SELECT task_id, CAST(sum(bytes) AS BIGINT) AS us FROM page_log GROUP BY task_id) USING (task_id)"""


def _results(log: DataFrame) -> DataFrame:
    """Task results as a worker would report them; every ninth task failed after its pages."""
    failed = F.substring_index("task_id", "t", -1).cast("long") % 9 == 0
    sums = log.groupBy("task_id").agg(F.count(F.lit(1)).alias("pages_crawled"), F.sum("bytes").alias("elapsed_ms"))
    return sums.withColumn("status", F.when(failed, "failed").otherwise("succeeded")).withColumn(
        "errors", F.lit(0).cast("long")
    )


@query(_SUMMARY, "page_log")
def task_summary_line(spark, sf_dir):
    log = V.page_log(spark, sf_dir)
    return G.summary_lines(_results(log), log).select(
        "task_id", "kind", "status", "saved", "rejected", "spooled", "pages_crawled", "errors", "elapsed_ms"
    )


@query(
    """SELECT website_id, CAST(sum(f) AS BIGINT) AS links_found, CAST(sum(saved) AS BIGINT) AS saved,
  CAST(sum(rejected) AS BIGINT) AS rejected, sum(saved) / nullif(sum(f), 0)::DOUBLE AS saved_rate,
  sum(rejected) / nullif(sum(f), 0)::DOUBLE AS rejected_rate FROM (
  SELECT website_id, CASE WHEN website_id = 'w3' THEN 0 ELSE count(*) END AS f, count(*) FILTER (outcome = 'saved') AS saved,
    count(*) FILTER (outcome = 'rejected') AS rejected FROM page_log GROUP BY task_id, website_id) GROUP BY website_id""",
    "page_log",
)
def failure_rate(spark, sf_dir):
    log = V.page_log(spark, sf_dir)
    found = F.when(F.col("website_id") == "w3", 0).otherwise(F.col("saved") + F.col("rejected") + F.col("spooled"))
    return G.failure_rate(DO.verdict_counts(log, ("task_id", "website_id")).withColumn("links_found", found))


@query(
    """SELECT client_id, lead_id, CAST(grouping_id(client_id, lead_id) AS BIGINT) AS level, count(*) AS pages,
  count(*) FILTER (outcome = 'saved') AS saved, count(*) FILTER (outcome = 'rejected') AS rejected,
  count(*) FILTER (outcome = 'spooled') AS spooled, CAST(sum(bytes) AS BIGINT) AS bytes
FROM page_log GROUP BY ROLLUP (client_id, lead_id)""",
    "page_log",
)
def log_rollup(spark, sf_dir):
    return G.log_rollup(V.page_log(spark, sf_dir))


@query(
    f"""SELECT count(*) FILTER (u % 5 <> 0) AS pushed_tasks, CAST(coalesce(sum(records) FILTER (u % 5 <> 0), 0) AS BIGINT)
  AS pushed_records, count(*) FILTER (u % 5 = 0) AS failed FROM {_FILES} WHERE records > 0""",
    "page_log",
)
def upload_totals(spark, sf_dir):
    files = _log_files(V.page_log(spark, sf_dir))
    return G.upload_totals(files, _receipts(files))


@query("SELECT page_id, key, arg_max(value, pos) AS value FROM meta_tags GROUP BY page_id, key", "meta_tags")
def meta_last_wins(spark, sf_dir):
    html = F.col("html")
    names = F.regexp_extract_all(html, F.lit(H.META), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(H.META), F.lit(2))
    tags = V.meta_pages(spark, sf_dir).select("page_id", F.posexplode(F.arrays_zip(names, values)).alias("pos", "t"))
    rows = tags.select(
        "page_id", "pos", F.lower(F.col("t")["0"]).alias("key"), F.substring(F.col("t")["1"], 1, H.META_CHARS).alias("value")
    )
    return P.meta_last_wins(rows)


# Order, limits, sets


@query("SELECT task_id, url, rank, depth FROM crawl_tasks_found", "crawl_tasks_found")
def bfs_rank(spark, sf_dir):
    return _discovered(spark, sf_dir)[0].select("task_id", "url", "rank", "depth")


@query(
    """SELECT v.task_id, v.url, v.rank AS done, least(CAST(v.budget AS BIGINT), (SELECT count(*) FROM crawl_tasks_found f
  WHERE f.task_id = v.task_id AND f.parent_rank <= v.rank)) AS total FROM crawl_tasks_found v WHERE v.visited""",
    "crawl_tasks_found",
)
def progress_total(spark, sf_dir):
    return C.progress_total(_discovered(spark, sf_dir)[0])


_KEPT = f"""kept AS (SELECT task_id, us, done, total FROM pings WHERE done = 1 AND total > 1
UNION ALL SELECT p.task_id, p.us, p.done, p.total FROM (
  SELECT k.task_id, min(p.done) AS done FROM kept k JOIN pings p ON p.task_id = k.task_id AND p.done > k.done
    AND (p.us - k.us >= {SIX_HOURS}000000 OR p.done = p.total) GROUP BY k.task_id, k.done) n
JOIN pings p USING (task_id, done))"""


def _with_kept(body: str) -> str:
    return O.sql("", "pings").rstrip() + f",\n{_KEPT}\n{body}"


@query()
def progress_throttle(spark, sf_dir):
    kept = throttle_progress(V.pings(spark, sf_dir), SIX_HOURS)
    return kept.select("task_id", F.unix_micros("ts").alias("us"), "done", "total")


ORACLES["progress_throttle"] = _with_kept("SELECT task_id, us, done, total FROM kept")


@query(
    """SELECT task_id, url, p[1] AS parent_rank, CAST(p[2] AS INTEGER) AS pos FROM (
  SELECT f.task_id, l.dst_url AS url, min([f.rank, l.pos]) AS p FROM crawl_tasks_found f JOIN links l ON l.src_url = f.url
    AND l.dst_host = regexp_extract(f.url, '://([^/?]*)', 1) WHERE f.visited GROUP BY ALL)""",
    "crawl_tasks_found",
    "links",
)
def first_occurrence(spark, sf_dir):
    return C.first_occurrence(_candidates(spark, sf_dir)[0], ["task_id", "url"])


@query("SELECT task_id, url, outcome, http_status, us FROM latest", "latest")
def latest_outcome(spark, sf_dir):
    newest = G.latest_outcome(V.repeat_log_of(V.page_log(spark, sf_dir)), ("ts", "event_id"))
    return newest.select("task_id", "url", "outcome", "http_status", F.unix_micros("ts").alias("us"))


@query("SELECT task_id, url, rank FROM crawl_tasks_ranked JOIN crawl_tasks USING (task_id) WHERE rank <= budget",
       "crawl_tasks_ranked")
def crawl_budget(spark, sf_dir):
    return _discovered(spark, sf_dir)[0].where("rank <= budget").select("task_id", "url", "rank")


@query("SELECT spool_id, task_id, spooled_at FROM spool ORDER BY spooled_at, spool_id LIMIT 100", "spool")
def flush_limit(spark, sf_dir):
    return DO.flush_batch(V.spool_errors(spark, sf_dir).drop("message"))


@query(f"SELECT {_PATH} AS path, count(*) AS records FROM page_log GROUP BY 1 ORDER BY 1", "page_log")
def log_file_order(spark, sf_dir):
    return logs_source.log_file_order(V.page_log(spark, sf_dir).withColumn("user_id", F.lit(None).cast("string")))


@query(
    "SELECT task_id, url FROM crawl_tasks_found UNION SELECT 'crawl:' || host, url FROM site_index",
    "crawl_tasks_found",
    "site_index",
)
def discovered_union(spark, sf_dir):
    index, snapshot = _sites(spark, sf_dir)
    found = C.discover(V.crawl_tasks(index), snapshot, unique=True).select("task_id", "url")
    return C.discovered_union(found, index.select(F.concat(F.lit("crawl:"), "host").alias("task_id"), "url"))


@query("SELECT task_id, url, rank FROM crawl_tasks_found WHERE NOT visited", "crawl_tasks_found")
def undiscovered(spark, sf_dir):
    return C.undiscovered(_discovered(spark, sf_dir)[0])


@query(
    f"""SELECT task_id, 'page' AS kind, url, outcome, bytes, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS saved
FROM page_log UNION ALL SELECT task_id, kind, NULL, NULL, NULL, status, saved FROM ({_SUMMARY})""",
    "page_log",
)
def page_log_union(spark, sf_dir):
    log = V.page_log(spark, sf_dir)
    both = G.page_log_union(_log_lines(log), G.summary_lines(_results(log), log))
    return both.select("task_id", "kind", "url", "outcome", "bytes", "status", "saved")


_VISITED = "SELECT task_id, rank, depth, url, title, content_length, error FROM crawl_tasks_visited"


@query(_VISITED, "crawl_tasks_visited")
def crawl_all(spark, sf_dir):
    index, snapshot = _sites(spark, sf_dir)
    visited = C.crawl_all(V.crawl_tasks(index), snapshot, unique=True)
    return visited.select("task_id", "rank", "depth", "url", "title", "content_length", "error")


@query(
    "SELECT task_id, CAST(depth AS INTEGER) AS depth, count(*) AS pages FROM crawl_tasks_found WHERE visited GROUP BY ALL",
    "crawl_tasks_found",
)
def crawl_depth(spark, sf_dir):
    return C.crawl_depth(_discovered(spark, sf_dir)[0].where("visited"))


# Streams


@query(
    """SELECT task_id, url, CASE WHEN bytes % 10 = 0 THEN 'spooled' WHEN bytes % 10 = 1 THEN 'rejected' ELSE 'saved' END
  AS outcome, CASE WHEN bytes % 10 = 0 THEN 'spool' ELSE 'pages' END AS sink
FROM (SELECT DISTINCT task_id, url, bytes FROM repeat_log)""",
    "repeat_log",
)
def stream_page_ingest(spark, sf_dir):
    log = V.repeat_log_of(V.page_log_of(V.in_utc(_stream(spark, sf_dir, "events"))))
    # The verdict depends on the page alone, so any copy of it may be the one that is kept.
    verdict = F.when(F.col("bytes") % 10 == 0, "spooled").when(F.col("bytes") % 10 == 1, "rejected").otherwise("saved")
    pages = log.select("task_id", "url", "ts", verdict.alias("outcome"))
    base = fresh_path(spark, "ingest")
    J.run_available(J.page_ingest(pages, f"{base}/pages", f"{base}/spool", late="60 days"), f"{base}/checkpoint")
    sinks = [spark.read.parquet(f"{base}/{s}").withColumn("sink", F.lit(s)) for s in ("pages", "spool")]
    return sinks[0].unionByName(sinks[1]).select("task_id", "url", "outcome", "sink")


@query(
    """SELECT task_id, epoch_us(day) AS start_us, count(*) FILTER (outcome = 'saved') AS saved,
  count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'spooled') AS spooled
FROM (SELECT *, date_trunc('day', ts) AS day FROM page_log) GROUP BY ALL""",
    "page_log",
)
def stream_outcome_counts(spark, sf_dir):
    log = V.page_log_of(V.in_utc(_stream(spark, sf_dir, "events")))
    counts = J.outcome_counts(log, "1 day", f"{LATE_SECONDS} seconds")
    base = fresh_path(spark, "counts")
    J.run_available(J.write_counts(counts, f"{base}/out"), f"{base}/checkpoint")
    return J.read_counts(spark.read.parquet(f"{base}/out")).select(
        "task_id", F.unix_micros("start").alias("start_us"), "saved", "rejected", "spooled"
    )


@query()
def stream_progress_throttle(spark, sf_dir):
    base = fresh_path(spark, "throttle")
    pings = written(V.pings(spark, sf_dir), "pings")
    # Three arrivals in time order, each processed by a restarted query.
    third = F.ceil(F.col("done") * 3 / F.col("total"))
    for arrival in (1, 2, 3):
        pings.where(third == arrival).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(pings.schema).parquet(f"{base}/in")
        writer = J.progress_throttle(arriving, f"{base}/out", SIX_HOURS)
        J.run_available(writer, f"{base}/checkpoint")
    return spark.read.schema(pings.schema).parquet(f"{base}/out").select(
        "task_id", F.unix_micros("ts").alias("us"), "done", "total"
    )


ORACLES["stream_progress_throttle"] = ORACLES["progress_throttle"]


@query("SELECT task_id, url, outcome, bytes, us // 1000000 AS ts FROM page_log", "page_log")
def stream_log_tail(spark, sf_dir):
    path = _write_node_logs(spark, sf_dir)
    base = fresh_path(spark, "tail")
    J.run_available(J.log_tail(logs_source.stream_log(spark, path, suffixes="txt"), f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("task_id", "url", "outcome", "bytes", "ts")


@query(f"{_FLUSH_TOTALS} FROM flushed", "flushed")
def stream_spool_retry(spark, sf_dir):
    base = fresh_path(spark, "retry")
    spool = V.spool_errors(spark, sf_dir)
    spool.drop("message").write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(spool.drop("message").schema).option("maxFilesPerTrigger", 100).parquet(f"{base}/in")
    replies = V.spool_replies(spool)
    J.run_available(J.spool_retry(arriving, replies, f"{base}/out", f"{base}/state"), f"{base}/checkpoint")
    left = J.read_spool_left(spark, f"{base}/state", arriving.schema).withColumn("flush_outcome", F.lit("remaining"))
    settled = spark.read.schema(left.schema).parquet(f"{base}/out").drop("batch_id")
    return DO.flush_totals(settled.unionByName(left))


_LIVE = f"""SELECT CAST(user_id AS VARCHAR) AS node, max(epoch_us(ts)) AS last_us,
  (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) <= {SIX_HOURS}000000 AS alive FROM events GROUP BY user_id"""


@query(_LIVE)
def node_liveness(spark, sf_dir):
    return G.node_liveness(V.heartbeats(spark, sf_dir), SIX_HOURS)


@query(_LIVE)
def stream_node_liveness(spark, sf_dir):
    beats = V.in_utc(_stream(spark, sf_dir, "events")).select(F.col("user_id").cast("string").alias("node"), "ts")
    base = fresh_path(spark, "beats")
    J.run_available(J.last_heartbeats(beats, f"{base}/out"), f"{base}/checkpoint")
    return G.node_liveness(spark.read.parquet(f"{base}/out").select("node", "ts"), SIX_HOURS)


# User functions

_RESULT = """SELECT id AS task_id, task_type, 'failed' AS status, error, 0::BIGINT AS pages_crawled, 0::BIGINT AS pages_saved,
  NULL::BIGINT AS links_found, 1::BIGINT AS errors, 0::BIGINT AS elapsed_ms FROM checked WHERE error IS NOT NULL {0}
UNION ALL SELECT c.id, c.task_type, CASE WHEN f.page_url IS NULL THEN 'failed' ELSE 'succeeded' END,
  CASE WHEN f.page_url IS NULL THEN 'not in snapshot' END, count(f.page_url), count(*) FILTER (f.content_length > 0), NULL,
  1 - count(f.page_url), 0 FROM checked c LEFT JOIN facts f ON f.page_url = c.url
  WHERE c.error IS NULL AND c.task_type IN ('crawl_single', 'crawl_single:meta', 'extract_meta') GROUP BY ALL
UNION ALL SELECT task_id, 'crawl_pages', 'succeeded', NULL, count(*), count(*) FILTER (content_length > 0), count(*),
  count(error), 0 FROM ({1}) GROUP BY task_id
UNION ALL SELECT task_id, c.task_type, 'succeeded', NULL, pages_crawled, pages_saved, links_found, errors, elapsed_ms
  FROM site_tasks_totals JOIN checked c ON c.id = task_id"""


@query(_RESULT.format("", _LIST_PAGES), "checked", "facts", "site_tasks_totals")
def execute_tasks_by_type(spark, sf_dir):
    index, snapshot = _sites(spark, sf_dir)
    return execute_tasks(V.mixed_tasks(index), snapshot, unique=True)


@query(
    _RESULT.format("AND task_type <> 'screenshot'", _LIST_PAGES)
    + """ UNION ALL SELECT c.id, c.task_type, 'succeeded', NULL, count(*), 0, NULL, 0, max(length(c.url))
FROM checked c WHERE task_type = 'screenshot' GROUP BY ALL""",
    "checked",
    "facts",
    "site_tasks_totals",
)
def handler_registry(spark, sf_dir):
    """A user's handler for a type the library does not know."""

    def screenshot(tasks: DataFrame, snapshot: DataFrame, unique: bool, hook) -> DataFrame:
        return tasks.select(
            F.col("id").alias("task_id"),
            F.lit(1).cast("long").alias("pages_crawled"),
            F.lit(0).cast("long").alias("pages_saved"),
            F.lit(None).cast("long").alias("links_found"),
            F.lit(0).cast("long").alias("errors"),
            F.length("payload.url").cast("long").alias("elapsed_ms"),
        )

    index, snapshot = _sites(spark, sf_dir)
    return execute_tasks(V.mixed_tasks(index), snapshot, unique=True, handlers={"screenshot": screenshot})


@query(
    f"""SELECT task_id, pos, url, CASE WHEN error IS NOT NULL THEN 'error' WHEN content_length >= 3000 THEN 'saved'
  ELSE 'rejected' END AS outcome, CASE WHEN error IS NOT NULL THEN error WHEN content_length < 3000 THEN 'short' END AS reason
FROM ({_LIST_PAGES})""",
    "checked",
    "facts",
)
def page_hook(spark, sf_dir):
    def keep_long(pages: DataFrame) -> DataFrame:
        short = F.col("content_length") < 3000
        outcome = F.when(F.col("error").isNotNull(), "error").when(short, "rejected").otherwise("saved")
        return pages.withColumns({"outcome": outcome, "reason": F.coalesce("error", F.when(short, "short"))})

    index, snapshot = _sites(spark, sf_dir)
    pages = P.crawl_pages(_valid_tasks(index, T.LIST_TYPES), snapshot, unique=True, hook=keep_long)
    return pages.select("task_id", "pos", "url", "outcome", "reason")


_TASK_PAGES = f"""SELECT c.id AS task_id, c.url, f.title, f.content_length,
  CASE WHEN f.page_url IS NULL THEN 'not in snapshot' END AS error FROM checked c LEFT JOIN facts f ON f.page_url = c.url
  WHERE c.error IS NULL AND c.task_type IN ('crawl_single', 'crawl_single:meta', 'extract_meta')
UNION ALL SELECT task_id, url, title, content_length, error FROM ({_LIST_PAGES})
UNION ALL SELECT task_id, url, title, content_length, error FROM site_tasks_visited"""

_VERDICT = """CASE WHEN error IS NOT NULL THEN 'error' WHEN content_length >= 3000 THEN 'saved'
  WHEN content_length >= 1500 THEN 'rejected' ELSE 'spooled' END"""


@query(
    f"""SELECT c.id AS task_id, c.task_type, c.client_id, c.website_id, c.url AS start_url, 'page' AS kind, p.url,
  p.outcome, p.title, p.content_length AS bytes, NULL AS status, NULL::BIGINT AS saved, NULL::BIGINT AS rejected,
  NULL::BIGINT AS spooled, NULL::BIGINT AS pages_crawled, NULL::BIGINT AS errors
FROM (SELECT *, {_VERDICT} AS outcome FROM ({_TASK_PAGES})) p JOIN checked c ON c.id = p.task_id
UNION ALL SELECT c.id, c.task_type, c.client_id, c.website_id, c.url, '_summary', NULL, NULL, NULL, NULL,
  CASE WHEN f THEN 'failed' ELSE 'succeeded' END, coalesce(saved, 0), coalesce(rejected, 0), coalesce(spooled, 0),
  CASE WHEN f THEN 0 ELSE coalesce(n, 0) END, CASE WHEN f THEN 1 ELSE coalesce(errors, 0) END
FROM (SELECT c.*, s.* EXCLUDE (task_id), c.error IS NOT NULL
    OR (c.task_type IN ('crawl_single', 'crawl_single:meta', 'extract_meta') AND s.errors > 0) AS f
  FROM checked c LEFT JOIN (SELECT task_id, count(*) AS n, count(error) AS errors, count(*) FILTER (outcome = 'saved') AS saved,
      count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'spooled') AS spooled
    FROM (SELECT *, {_VERDICT} AS outcome FROM ({_TASK_PAGES})) GROUP BY task_id) s ON s.task_id = c.id) c""",
    "checked",
    "facts",
    "site_tasks_visited",
)
def crawl_log(spark, sf_dir):
    """Tasks of every type, to page lines and summaries."""

    def by_length(pages: DataFrame) -> DataFrame:
        size = F.col("content_length")
        kept = F.when(size >= 3000, "saved").when(size >= 1500, "rejected").otherwise("spooled")
        outcome = F.when(F.col("error").isNotNull(), "error").otherwise(kept)
        return pages.withColumns({"outcome": outcome, "reason": F.col("error")})

    index, snapshot = _sites(spark, sf_dir)
    return log_of_tasks(V.mixed_tasks(index), snapshot, unique=True, hook=by_length).select(
        "task_id", "task_type", "client_id", "website_id", "start_url", "kind", "url", "outcome", "title", "bytes", "status",
        "saved", "rejected", "spooled", "pages_crawled", "errors",
    )


QUERIES["execute_tasks"] = QUERIES.pop("execute_tasks_by_type")
ORACLES["execute_tasks"] = ORACLES.pop("execute_tasks_by_type")
