"""Task tables: types, validation, dispatch and user functions."""

from pyspark.sql import functions as F

from sitegraph.operators.pages import crawl_pages, crawl_single, list_totals
from sitegraph.operators.registry import execute_tasks
from sitegraph.schemas import TASK
from sitegraph.sources import tasks as T
from sitegraph.sources.snapshot import as_snapshot

EMPTY = dict.fromkeys(TASK["payload"].dataType.names)


def tasks_of(spark, *rows):
    return spark.createDataFrame([(i, t, {**EMPTY, **p}) for i, t, p in rows], TASK)


def snapshot_of(spark):
    html = '<title>t</title><meta name="description" content="d"><a href="/b">'
    return as_snapshot(
        spark.createDataFrame([("http://h/a", html), ("http://h/b", ""), ("http://h/c", "x")], "url string, html string")
    )


def test_type_filter(spark):
    tasks = tasks_of(spark, ("1", "crawl", {}), ("2", "crawl_pages", {}), ("3", "other", {}), ("4", None, {}))

    def kept(*pinned):
        return sorted(r.id for r in T.filter_tasks(tasks, list(pinned)).collect())

    assert kept() == kept("other") == kept("", " ") == ["1", "2"]
    assert kept(" crawl ", "other") == ["1"]


def test_dispatch_isolates_failures(spark):
    tasks = tasks_of(
        spark,
        ("site", "crawl_sitemap", {"url": "http://h/a/", "max_pages": 0}),
        ("one", "extract_meta", {"url": "http://h/a"}),
        ("gone", "crawl_single", {"url": "http://h/zzz"}),
        ("list", "crawl_pages", {"pages": ["http://h/c", "", None, "http://h/c", "http://h/no"]}),
        ("no-url", "crawl_all", {"url": ""}),
        ("no-pages", "crawl_pages", {"pages": ["", None]}),
        ("null-pages", "crawl_pages", {}),
        ("odd", "video", {"url": "http://h/a"}),
        ("null", None, {}),
    )
    got = {r.task_id: r for r in execute_tasks(tasks, snapshot_of(spark)).collect()}
    columns = ("status", "pages_crawled", "pages_saved", "links_found", "errors")
    assert {k: tuple(r[c] for c in columns) for k, r in got.items()} == {
        "site": ("succeeded", 2, 1, 2, 0),
        "one": ("succeeded", 1, 1, None, 0),
        "gone": ("failed", 0, 0, None, 1),
        "list": ("succeeded", 3, 2, 3, 1),
        **{k: ("failed", 0, 0, None, 1) for k in ("no-url", "no-pages", "null-pages", "odd", "null")},
    }
    assert got["odd"].error == "no handler registered for task_type='video'"
    assert got["null"].error == "no handler registered for task_type=None"
    assert got["no-url"].error == "task payload has no 'url'"
    assert got["no-pages"].error == "crawl_pages task has no 'pages'"


def test_single_and_list(spark):
    tasks = tasks_of(spark, ("1", "crawl_single", {"url": "http://h/a"}), ("2", "crawl_pages", {"pages": ["http://h/c"] * 2}))
    one = crawl_single(tasks.where("id = '1'"), snapshot_of(spark)).first()
    assert (one.title, one.description, one.keywords, one.pages_saved, one.error) == ("t", "d", None, 1, None)
    pages = crawl_pages(tasks.where("id = '2'"), snapshot_of(spark))
    assert [(r.pos, r.url) for r in pages.orderBy("pos").collect()] == [(0, "http://h/c"), (1, "http://h/c")]
    assert tuple(list_totals(pages).first())[:5] == ("2", 2, 2, 2, 0)


def test_user_handler_and_hook(spark):
    def count_only(tasks, snapshot, unique, hook):
        one = F.lit(1).cast("long")
        return tasks.select(F.col("id").alias("task_id"), *[one.alias(c) for c in ("pages_crawled", "pages_saved", "links_found", "errors", "elapsed_ms")])

    tasks = tasks_of(spark, ("1", "count_only", {}), ("2", "crawl_single", {"url": "http://h/a"}))

    def refuse(pages):
        return pages.withColumns({"outcome": F.lit("rejected"), "reason": F.lit("policy")})

    got = {r.task_id: (r.status, r.pages_saved) for r in execute_tasks(
        tasks, snapshot_of(spark), hook=refuse, handlers={"count_only": count_only}
    ).collect()}
    assert got == {"1": ("succeeded", 1), "2": ("succeeded", 0)}


def test_read_tasks_takes_any_spelling_of_a_number(spark, tmp_path):
    spelled = ['20', '"20"', '20.0', '"20.0"', 'null', '"many"', '0']
    lines = [f'{{"id": "{k}", "task_type": "crawl", "payload": {{"url": "u", "max_pages": {v}}}}}' for k, v in enumerate(spelled)]
    (tmp_path / "tasks.json").write_text("\n".join(lines))
    tasks = T.read_tasks(spark, str(tmp_path / "tasks.json"))
    assert tasks.schema["payload"].dataType["max_pages"].dataType == TASK["payload"].dataType["max_pages"].dataType
    assert [r[0] for r in tasks.orderBy("id").select("payload.max_pages").collect()] == [20, 20, 20, 20, None, None, 0]
