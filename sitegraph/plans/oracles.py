"""Independent SQL (DuckDB dialect) for the registered queries, over the same parquet tables.

`VIEWS` holds the inputs and shared steps as common table expressions; `sql` puts those a query needs
in front of it.
"""

from __future__ import annotations

# The same patterns and word lists as the functions, written for this dialect.
HREF = """(?i)href=["'']([^"''#]+)["'']"""
TITLE = "(?is)<title[^>]*>(.*?)</title>"
META = """(?i)<meta[^>]+(?:name|property)=["'']([^"'']+)["''][^>]+content=["'']([^"'']*)["'']"""
SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
EXTENSIONS = r"\.(pdf|jpg|jpeg|png|gif|svg|webp|bmp|tiff|avif|zip|mp4|css|js|ico|xml|json|woff|woff2|ttf)"
HINTS = ("css_combine", "js_combine", "css_cache", "js_cache", ".css?", ".js?", "ai_skin=")
META_KEYS = ("description", "keywords", "og:title", "og:description", "og:site_name")
TASK_TYPES = ("crawl_single", "crawl_single:meta", "extract_meta", "crawl_pages", "crawl_all", "crawl", "crawl_sitemap")


def part(url: str, n: int) -> str:
    """Scheme, netloc, path or query (n = 1..4) of a URL."""
    text = f"regexp_extract({url}, '{SPLIT}', {n})"
    return f"lower({text})" if n == 1 else text


def rejoin(scheme: str, netloc: str, path: str, query: str) -> str:
    return f"{scheme} || '://' || {netloc} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"


def normal(url: str) -> str:
    segments = rf"string_split(regexp_replace({part(url, 3)}, ';[^/]*$', ''), '/')"
    kept = (
        f"list_transform(list_filter(list_zip({segments}, list_prepend(NULL, {segments})), "
        "lambda z: z[1] = '' OR z[2] IS NULL OR z[1] <> z[2]), lambda z: z[1])"
    )
    path = f"rtrim(array_to_string({kept}, '/'), '/')"
    return rejoin(part(url, 1), part(url, 2), path, part(url, 4))


def resolve(base: str, href: str) -> str:
    """RFC 3986 resolution of a reference against an http(s) page."""
    own = rf"regexp_replace({part(href, 3)}, ';[^/]*$', '')"
    params = f"regexp_extract({part(href, 3)}, ';[^/]*$', 0)"
    directory = f"regexp_extract({part(base, 3)}, '^(.*/)?', 0)"
    joined = (
        f"CASE WHEN starts_with({own}, '/') THEN {own} "
        f"ELSE regexp_replace('/' || {directory} || {own}, '/+', '/', 'g') END"
    )
    folded = (
        f"list_reduce(list_transform(string_split({joined}, '/'), lambda x: [x]), lambda acc, x: "
        "CASE x[1] WHEN '..' THEN acc[:-2] WHEN '.' THEN acc ELSE list_concat(acc, x) END, []::VARCHAR[])"
    )
    path = f"'/' || ltrim(array_to_string({folded}, '/'), '/') || {params}"
    absolute = f"{part(href, 1)} NOT IN ('', {part(base, 1)}) OR {part(href, 2)} <> ''"
    full = f"CASE WHEN {part(href, 1)} <> '' THEN {href} ELSE {part(base, 1)} || ':' || {href} END"
    relative = rejoin(part(base, 1), part(base, 2), path, part(href, 4))
    return f"CASE WHEN {absolute} THEN {full} ELSE {relative} END"


def asset_path(url: str) -> str:
    return f"regexp_matches(lower({part(url, 3)}), '{EXTENSIONS}$')"


def infra_path(url: str) -> str:
    return "(" + " OR ".join(
        f"starts_with({part(url, 3)}, '{p}')" for p in ("/cdn-cgi/", "/wp-json/", "/xmlrpc.php", "/feed")
    ) + ")"


def asset_hint(url: str) -> str:
    return "(" + " OR ".join(f"contains(lower({url}), '{h}')" for h in HINTS) + ")"


def asset_query(url: str) -> str:
    return f"regexp_matches(lower({part(url, 4)}), '{EXTENSIONS}')"


def pseudo(href: str) -> str:
    return rf"regexp_matches({href}, '(?i)^\s*(mailto|tel|javascript|data):')"


def slug(c: str) -> str:
    safe = rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}_.-]', '_', 'g')"
    return f"CASE WHEN coalesce({c}, '') = '' THEN '_' WHEN regexp_matches({c}, '^\\.+$') THEN '_' || {c} ELSE {safe} END"


def title(html: str) -> str:
    return f"left(trim(regexp_extract_all({html}, '{TITLE}', 1)[1]), 300)"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "site_index": (
        (),
        """SELECT page_id, host, url, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rnk FROM (
  SELECT min(page_id) AS page_id, url, string_split(string_split(url, '://')[2], '/')[1] AS host FROM (
    SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url FROM pages) GROUP BY url)""",
    ),
    "site_pages": (
        ("site_index",),
        """SELECT p.page_id, p.host, p.url, p.rnk,
  CASE WHEN a.url IS NULL THEN '' ELSE '<a href="' || replace(a.url, '&', '&amp;') || '">l</a>' END ||
  CASE WHEN b.url IS NULL THEN '' ELSE '<a href="' || replace(b.url, '&', '&amp;') || '">r</a>' END || g.html AS html
FROM site_index p JOIN pages g USING (page_id)
LEFT JOIN site_index a ON a.host = p.host AND a.rnk = 2 * p.rnk
LEFT JOIN site_index b ON b.host = p.host AND b.rnk = 2 * p.rnk + 1""",
    ),
    "crawl_tasks": (
        ("site_index",),
        """SELECT 'crawl:' || host AS task_id, url AS start, host,
  CASE WHEN length(host) % 3 = 0 THEN 50 WHEN length(host) % 3 = 1 THEN 5 ELSE 20 END AS budget
FROM site_index WHERE rnk = 1""",
    ),
    "mixed": (
        ("site_index",),
        """SELECT page_id, 'task:' || page_id AS id,
  ['crawl_single', 'crawl_single:meta', 'extract_meta', 'crawl_pages', 'crawl_all', 'crawl_sitemap', 'screenshot',
   'crawl_pages'][page_id % 8 + 1] AS task_type,
  CASE WHEN page_id % 10 = 9 THEN url || '/gone' WHEN page_id % 10 <> 7 THEN url END AS url,
  CASE WHEN page_id % 16 = 7 THEN [''] ELSE [url, '', url || '/gone', NULL, url] END AS list,
  CASE page_id % 4 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 20 END AS max_pages,
  CASE WHEN page_id % 11 <> 0 THEN 'c' || page_id % 7 END AS client_id,
  CASE WHEN page_id % 11 <> 0 THEN 'l' || page_id % 31 END AS lead_id,
  'w' || page_id % 13 AS website_id, 'u' || page_id % 5 AS user_id, 'r' || page_id AS redis_job_id FROM site_index""",
    ),
    "checked": (
        ("mixed",),
        f"""SELECT *, CASE WHEN task_type NOT IN ({quoted(TASK_TYPES)})
    THEN 'no handler registered for task_type=''' || task_type || ''''
  WHEN task_type = 'crawl_pages' THEN CASE WHEN page_id % 16 = 7 THEN 'crawl_pages task has no ''pages''' END
  WHEN url IS NULL THEN 'task payload has no ''url''' END AS error FROM mixed""",
    ),
    "site_tasks": (
        ("checked",),
        f"""SELECT id AS task_id, {normal("url")} AS start, {part("url", 2)} AS host,
  CASE WHEN coalesce(max_pages, 0) = 0 THEN 50 ELSE max_pages END AS budget
FROM checked WHERE task_type IN ('crawl_all', 'crawl_sitemap') AND error IS NULL""",
    ),
    "facts": (
        ("site_pages",),
        f"SELECT url AS page_url, length(html) AS content_length, {title('html')} AS title FROM site_pages",
    ),
    "hrefs": (
        ("site_pages",),
        f"""SELECT url AS src_url, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos
FROM (SELECT url, regexp_extract_all(html, '{HREF}', 1) AS hs FROM site_pages)""",
    ),
    "located": (
        ("hrefs",),
        f"""SELECT src_url, pos, {normal("u")} AS dst_url FROM (SELECT src_url, pos, {resolve("src_url", "h")} AS u FROM (
  SELECT src_url, pos, replace(href, '&amp;', '&') AS h FROM hrefs) WHERE NOT {pseudo("h")})""",
    ),
    "links": (
        ("located",),
        f"""SELECT src_url, pos, dst_url, {part("dst_url", 2)} AS dst_host FROM located
WHERE {part("dst_url", 1)} IN ('http', 'https') AND NOT {asset_path("dst_url")} AND NOT {infra_path("dst_url")}
  AND NOT {asset_hint("dst_url")} AND NOT {asset_query("dst_url")}""",
    ),
    "page_log": (
        (),
        """SELECT event_id, 't' || user_id AS task_id, CASE WHEN user_id % 11 <> 0 THEN 'c' || user_id % 7 END AS client_id,
  CASE WHEN user_id % 11 <> 0 THEN 'l' || user_id % 31 END AS lead_id, 'w' || user_id % 13 AS website_id,
  'https://h' || user_id % 7 || '.example.com/' || event_id AS url,
  CASE event_type WHEN 'error' THEN 'spooled' WHEN 'signup' THEN 'rejected' ELSE 'saved' END AS outcome,
  CASE event_type WHEN 'signup' THEN 403 ELSE 200 END AS http_status,
  CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS bytes, ts, epoch_us(ts) AS us FROM events""",
    ),
    "repeat_log": (
        ("page_log",),
        "SELECT * REPLACE ('https://h.example.com/' || bytes AS url) FROM page_log",
    ),
    "latest": (
        ("repeat_log",),
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, url ORDER BY us DESC, event_id DESC) AS k
FROM repeat_log) WHERE k = 1""",
    ),
    "attempts": (
        (),
        """SELECT CAST(floor(event_id / 3) AS BIGINT) AS page_key, event_id % 3 + 1 AS attempt,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'rejected' ELSE 'saved' END AS verdict FROM events""",
    ),
    "spool": (
        (),
        """SELECT event_id AS spool_id, 't' || user_id AS task_id, epoch_us(ts) AS spooled_at, CASE event_id % 4
  WHEN 0 THEN '409: Task NOT ASSIGNED to this worker' WHEN 1 THEN '404: page'
  WHEN 2 THEN 'request to /page failed: read timed out' ELSE 'task not found' END AS message
FROM events WHERE event_type = 'error'""",
    ),
    "flushed": (
        ("spool",),
        """SELECT spool_id, task_id, spooled_at, CASE WHEN spool_id % 7 = 6 THEN 'remaining'
  WHEN spool_id % 3 = 0 THEN 'recovered' WHEN spool_id % 3 = 1 THEN 'rejected'
  WHEN spool_id % 5 = 0 THEN 'remaining'
  WHEN contains(lower(message), 'not assigned') OR contains(lower(message), 'not found') OR contains(message, '404')
    THEN 'dropped' ELSE 'remaining' END AS flush_outcome FROM spool""",
    ),
    "pings": (
        (),
        """SELECT CAST(user_id AS VARCHAR) AS task_id, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total
FROM events""",
    ),
    "raw_links": (
        (),
        """SELECT event_id AS link_id, 'https://h' || user_id % 7 || '.example.com/a/b' AS base_url, CASE event_id % 10
  WHEN 0 THEN '/p/' || event_id WHEN 1 THEN 'mailto:x@example.com' WHEN 2 THEN '/s.CSS?v=' || event_id
  WHEN 3 THEN '/cdn-cgi/l/email' WHEN 4 THEN '/min?f=app.js' WHEN 5 THEN '/css_combine?x=1'
  WHEN 6 THEN '../c/' || event_id || '/' WHEN 7 THEN 'https://other.example.org/x'
  WHEN 8 THEN '/en/en/' || event_id || '?a=1&amp;b=2' ELSE '/feedback' END AS href FROM events""",
    ),
    "raw_located": (
        ("raw_links",),
        f"""SELECT link_id, base_url, href, {normal("u")} AS url FROM (
  SELECT link_id, base_url, href, {resolve("base_url", "h")} AS u FROM (
    SELECT *, replace(href, '&amp;', '&') AS h FROM raw_links) WHERE NOT {pseudo("h")})""",
    ),
    "responses": (
        (),
        """SELECT event_id AS fetch_id, CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 WHEN 'click' THEN 404
  ELSE 200 END AS http_status, CASE event_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/xhtml+XML'
  WHEN 2 THEN 'application/pdf' END AS content_type, CASE event_id % 5 WHEN 1 THEN '1.5' WHEN 2 THEN '120'
  WHEN 3 THEN 'Wed, 21 Oct 2026 07:28:00 GMT' WHEN 4 THEN '-3' END AS retry_after FROM events""",
    ),
    "meta_tags": (
        (),
        f"""SELECT page_id, generate_subscripts(ks, 1) AS pos, lower(unnest(ks)) AS key, left(unnest(vs), 500) AS value FROM (
  SELECT page_id, regexp_extract_all(html, '{META}', 1) AS ks, regexp_extract_all(html, '{META}', 2) AS vs FROM (
    SELECT page_id, '<meta name="Description" content="first ' || page_id || '"><META property=''og:title'' content='''
      || url || '''><meta name="viewport" content="w"><meta content="no" name="keywords"><meta' || chr(10)
      || ' name="description" content="it''s ' || page_id || '"><meta property="og:site_name" content="">'
      || '<meta name="description" content="last ' || page_id || '">' || html AS html FROM pages))""",
    ),
}


def crawl_views(tasks: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Breadth-first traversal of `tasks(task_id, start, host, budget)` as steps named after it.

    The list of link positions on the way to a page orders pages as a queue would: by depth, then
    by path. Budgets only cut that order off, so ranks are computed without them.
    """
    t = tasks
    return {
        f"{t}_walk": (
            (t, "links"),
            f"""SELECT task_id, start AS url, CAST(NULL AS VARCHAR) AS parent, host, 0 AS depth, []::BIGINT[] AS path FROM {t}
UNION ALL SELECT w.task_id, l.dst_url, w.url, w.host, w.depth + 1, list_append(w.path, CAST(l.pos AS BIGINT))
FROM {t}_walk w JOIN links l ON l.src_url = w.url AND l.dst_host = w.host""",
        ),
        f"{t}_ranked": (
            (f"{t}_walk",),
            f"""SELECT task_id, url, parent, depth, row_number() OVER (PARTITION BY task_id ORDER BY depth, path) AS rank,
  CASE WHEN depth = 0 THEN 0 ELSE path[-1] END AS pos
FROM (SELECT *, row_number() OVER (PARTITION BY task_id, url ORDER BY depth, path) AS k FROM {t}_walk) WHERE k = 1""",
        ),
        f"{t}_found": (
            (f"{t}_ranked",),
            f"""SELECT r.task_id, r.url, r.rank, r.depth, r.pos, coalesce(p.rank, 0) AS parent_rank, t.budget,
  r.rank <= t.budget AS visited FROM {t}_ranked r JOIN {t} t USING (task_id)
LEFT JOIN {t}_ranked p ON p.task_id = r.task_id AND p.url = r.parent
WHERE r.depth = 0 OR p.rank <= t.budget""",
        ),
        f"{t}_visited": (
            (f"{t}_found", "facts"),
            f"""SELECT f.*, q.content_length, q.title, CASE WHEN q.page_url IS NULL THEN 'not in snapshot' END AS error
FROM {t}_found f LEFT JOIN facts q ON q.page_url = f.url WHERE f.visited""",
        ),
        f"{t}_totals": (
            (f"{t}_visited", f"{t}_found"),
            f"""SELECT f.task_id, count(v.url) AS pages_crawled, count(*) FILTER (v.content_length > 0) AS pages_saved,
  count(v.error) AS errors, count(*) AS links_found, CAST(0 AS BIGINT) AS elapsed_ms, CAST(0 AS DOUBLE) AS elapsed_seconds
FROM {t}_found f LEFT JOIN {t}_visited v ON v.task_id = f.task_id AND v.url = f.url GROUP BY f.task_id""",
        ),
    }


VIEWS |= crawl_views("crawl_tasks") | crawl_views("site_tasks")


def sql(body: str, *views: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for need in VIEWS[name][0]:
                add(need)
            ordered.append(name)

    for view in views:
        add(view)
    if not ordered:
        return body
    steps = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)
    return f"WITH RECURSIVE {steps}\n{body}"
