"""Many budgeted crawls at once against a plain queue."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from sitegraph.operators import crawl as C
from sitegraph.sources.snapshot import as_snapshot, fetch

BUDGETS = [None, 0, 1, 2, 5, 50, -1]


def queue_model(links, start, budget):
    """(visited in order, discovered, progress totals) of one crawl."""
    budget = budget or 50
    seen, order, totals = {start}, deque([start]), []
    visited = []
    while order and len(visited) < budget:
        url = order.popleft()
        visited.append(url)
        for link in links.get(url, []):
            if link not in seen:
                seen.add(link)
                order.append(link)
        totals.append(min(budget, len(seen)))
    return visited, seen, totals


@pytest.fixture(scope="module")
def graphs():
    """Random sites with cycles, self-links, repeats, absent pages, and links to other hosts."""
    rnd = random.Random(3)
    pages, links, tasks = [], {}, []
    for site in range(40):
        host = f"h{site}.example"
        names = [f"http://{host}/p{i}" for i in range(rnd.randint(1, 25))]
        for url in names:
            if rnd.random() < 0.2 and url != names[0]:
                continue
            out = [rnd.choice(names) for _ in range(rnd.randint(0, 6))]
            links[url] = out
            foreign = f"http://h{(site + 1) % 40}.example/p0"
            html = "".join(f'<a href="{u}">' for u in [foreign, *out])
            pages.append((len(pages), url, html))
        for i, budget in enumerate(BUDGETS):
            tasks.append((f"{site}-{i}", names[0] + "/", budget))
    # Copies of a URL: the lowest page_id counts.
    pages.append((len(pages), pages[0][1], '<a href="/other">'))
    return pages, links, tasks


def test_crawls_equal_a_queue(spark, graphs, monkeypatch, many_partitions):
    pages, links, tasks = graphs
    monkeypatch.setattr(C, "_PARENTS", 2)
    monkeypatch.setattr(C, "_COMPACT_EVERY", 3)
    snapshot = as_snapshot(spark.createDataFrame(pages, "page_id long, url string, html string"))
    frame = spark.createDataFrame(tasks, "task_id string, url string, max_pages int")
    discovered = C.discover(frame, snapshot).persist()
    visited = C.visit(discovered, snapshot)
    found, seen, errors = {}, {}, set()
    for r in discovered.collect():
        seen.setdefault(r.task_id, []).append(r.url)
    for r in visited.collect():
        found.setdefault(r.task_id, {})[r.rank] = r.url
        if r.error:
            errors.add(r.url)
    progress = {}
    for r in C.progress_total(discovered).collect():
        progress.setdefault(r.task_id, {})[r.done] = r.total
    totals = {r.task_id: r for r in C.crawl_totals(visited, discovered).collect()}
    for task, url, budget in tasks:
        order, discovery, steps = queue_model(links, url.rstrip("/"), budget)
        mine = found.get(task, {})
        assert [mine[k] for k in sorted(mine)] == order
        assert sorted(seen[task]) == sorted(discovery)
        assert [progress.get(task, {})[k] for k in range(1, len(order) + 1)] == steps
        assert totals[task].pages_crawled == len(order)
        assert totals[task].links_found == len(discovery)
        assert totals[task].errors == sum(u not in links for u in order)
    assert errors and not errors & set(links)
    discovered.unpersist()


def test_many_tasks_share_one_start(spark):
    """One start asked for by most tasks is crawled once and fanned out."""
    html = "".join(f'<a href="/p{i}">' for i in range(9))
    snapshot = as_snapshot(spark.createDataFrame([(0, "http://h/", html)], "page_id long, url string, html string"))
    tasks = spark.range(3000).select(
        F.col("id").cast("string").alias("task_id"),
        F.lit("http://h").alias("url"),
        (F.col("id") % 12 + 1).cast("int").alias("max_pages"),
    )
    rows = C.discover(tasks, snapshot).where("visited").groupBy("task_id").count().collect()
    assert {int(r.task_id): r["count"] for r in rows} == {i: min(i % 12 + 1, 10) for i in range(3000)}


def test_final_url_and_media_type(spark):
    rows = [
        (1, "http://h/a", "http://h/dir/a2", "text/html", '<a href="x">'),
        (2, "http://h/dir/x", None, "application/pdf", '<a href="/never">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, final_url string, content_type string, html string")
    tasks = spark.createDataFrame([("t", "http://h/a", None)], "task_id string, url string, max_pages int")
    visited = C.crawl_all(tasks, as_snapshot(pages))
    got = {r.url: (r.rank, r.content_length, r.outcome) for r in visited.collect()}
    assert got == {"http://h/a": (1, 12, "saved"), "http://h/dir/x": (2, 0, None)}


def test_no_tasks(spark):
    snapshot = as_snapshot(spark.createDataFrame([(1, "http://h", "")], "page_id long, url string, html string"))
    none = spark.createDataFrame([], "task_id string, url string, max_pages int")
    assert C.discover(none, snapshot).count() == 0


def test_fetch_keeps_repeats_and_reports_absent(spark):
    snapshot = as_snapshot(spark.createDataFrame([("http://h/a/", "<title>t</title>")], "url string, html string"))
    frontier = spark.createDataFrame([(1, "http://h/a"), (2, "http://h/a/#x"), (3, "http://h/b")], "k int, url string")
    got = {r.k: (r.title, r.http_status, r.error) for r in fetch(frontier, snapshot).collect()}
    assert got == {1: ("t", 200, None), 2: ("t", 200, None), 3: (None, None, "not in snapshot")}


def test_equal_copies_without_page_id(spark):
    html = '<a href="/b">'
    rows = [("http://h/a", html), ("http://h/a", html), ("http://h/a/", html), ("http://h/b", "x")]
    snapshot = as_snapshot(spark.createDataFrame(rows, "url string, html string"))
    tasks = spark.createDataFrame([("t", "http://h/a", None)], "task_id string, url string, max_pages int")
    got = sorted((r.url, r.rank, r.error) for r in C.crawl_all(tasks, snapshot).collect())
    assert got == [("http://h/a", 1, None), ("http://h/b", 2, None)]


def test_html_is_not_carried_through_the_crawl(spark, small):
    """The link table reads url and html only, and the visited join never shuffles html."""
    from sitegraph.operators.links import link_table
    from sitegraph.sources.snapshot import page_facts

    pages = spark.read.parquet(f"{small}/pages.parquet")
    for df in (link_table(as_snapshot(pages)), page_facts(as_snapshot(pages))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            assert "Exchange" not in line or "html" not in line


def test_any_place_of_a_link(spark):
    top = 2**63 - 1
    rows = [("a", 1, 2**24), ("a", 2, 5), ("b", 1, top), ("b", 1, 2**40), ("c", top, top), ("c", top, 0)]
    df = spark.createDataFrame(rows, "url string, parent_rank long, pos long")
    got = {r.url: (r.parent_rank, r.pos) for r in C.first_occurrence(df, ["url"]).collect()}
    assert got == {"a": (1, 2**24), "b": (1, 2**40), "c": (top, 0)}


def test_long_pages_are_read_whole(spark):
    html = "x" * 3_000_100 + '<a href="/late"><title>late</title>'
    snapshot = as_snapshot(spark.createDataFrame([(1, "http://h/a", html)], "page_id long, url string, html string"))
    assert [r.dst_url for r in C.link_table(snapshot).collect()] == ["http://h/late"]
    assert C.link_table(snapshot, limit=3_000_000).count() == 0
    assert C.fetch(snapshot.select("url"), snapshot).first().title == "late"
