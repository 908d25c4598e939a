"""Log files, sinks, uploads and receipts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sitegraph.functions.paths import slug
from sitegraph.operators import logs as G
from sitegraph.sources import logs as S
from sitegraph.sources import pages as SP


def test_slug_and_paths(spark):
    cases = [("a b/c", "a_b_c"), ("é-1_x.y", "é-1_x.y"), ("", "_"), (None, "_"), ("..", "_.."), (".", "_."), ("²", "²")]
    df = spark.createDataFrame(cases, "v string, want string")
    assert all(r.want == r.got for r in df.select("want", slug(F.col("v")).alias("got")).collect())
    rows = [
        ("t", "c", "l", "w", "u", "c/l/t.jsonl"),
        ("t", None, "l", "w", "u", "_/l/t.jsonl"),
        ("t", "", None, "w", "u", "_unfiled/w/t.jsonl"),
        ("t", None, None, "", "u", "_unfiled/u/t.jsonl"),
        ("t", None, None, None, None, "_unfiled/_/t.jsonl"),
        ("t", "..", "l", None, None, "_../l/t.jsonl"),
    ]
    ids = spark.createDataFrame(
        rows, "task_id string, client_id string, lead_id string, website_id string, user_id string, want string"
    )
    got = S.log_path(ids).select("want", F.concat_ws("/", "client_dir", "lead_dir", "file").alias("got"))
    assert all(r.want == r.got for r in got.collect())


@pytest.fixture
def node_logs(tmp_path):
    page = json.dumps({"kind": "page", "task_id": "t1", "url": "u", "outcome": "saved", "ts": 5, "bytes": 7})
    summary = json.dumps({"kind": "_summary", "task_id": "t1", "saved": 1, "status": "succeeded"})
    files = {
        "c/l/t1.jsonl": f"{page}\n\n{{broken\n5\n{summary}\n",
        "c/l/empty.jsonl": "",
        "c/l/m/n/o/t7.jsonl": page.replace("t1", "t7"),
        "_unfiled/w/t2.jsonl": page.replace("t1", "t2"),
        "_posted/c/t3.jsonl": page.replace("t1", "t3"),
        "_posted/t3.jsonl": page.replace("t1", "t3"),
        "c/l/t4.json.tmp": page.replace("t1", "t4"),
        "top.jsonl": page.replace("t1", "t5") + '\n{"task_id": "t6", "bytes": "many", "http_status": "404"} \n',
    }
    for name, text in files.items():
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "logs")


def test_tolerant_scan(spark, node_logs):
    rows = S.read_log(spark, node_logs)
    got = sorted((r.task_id, r.kind or "", r.bytes, r.http_status) for r in rows.collect())
    assert got == [
        ("t1", "_summary", None, None), ("t1", "page", 7, None), ("t2", "page", 7, None), ("t5", "page", 7, None),
        ("t6", "", None, 404), ("t7", "page", 7, None),
    ]
    assert rows.count() == 6
    assert S.read_log(spark, node_logs, archive="_unfiled").where("task_id = 't3'").count() == 2
    with pytest.raises(ValueError):
        S.stream_log(spark, node_logs)
    assert S.stream_log(spark, node_logs, depth=6).isStreaming


def _log(spark, rows):
    return spark.createDataFrame(rows, "task_id string, url string, outcome string, ts long, client_id string, lead_id string")


def test_write_then_read(spark, tmp_path):
    log = _log(spark, [("t", "u1", "saved", 1, "c", "l"), ("t", "u2", "error", 2, None, None)])
    lines = G.page_lines(log.withColumn("reason", F.lit("r")))
    S.write_log(lines, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out"))[-2:] == ["client_dir=_unfiled", "client_dir=c"]
    back = S.read_log(spark, str(tmp_path / "out"))
    assert sorted((r.url, r.outcome, r.kind, r.client_id) for r in back.collect()) == [
        ("u1", "saved", "page", "c"),
        ("u2", "error", "page", None),
    ]


def test_upload_replaces_a_task(spark, tmp_path):
    path = str(tmp_path / "up")
    rows = [(t, f"u{i}", "saved", i, "c", "l") for t in ("a", "b", "c") for i in range(7)]
    G.upload_batches(G.log_batches(_log(spark, rows), size=3), path, buckets=2)
    G.upload_batches(G.log_batches(_log(spark, [("a", "new", "saved", 9, "c", "l")]), size=3), path, buckets=2)
    got = spark.read.parquet(path).groupBy("task_id").agg(F.sum("records"), F.count("*")).collect()
    assert {tuple(r) for r in got} == {("a", 1, 1), ("b", 7, 3), ("c", 7, 3)}


def test_batches_bound_a_hot_task(spark):
    log = _log(spark, [("hot", f"u{i:04}", "saved", i // 10, "c", "l") for i in range(2500)])
    batches = G.log_batches(log, size=400).orderBy("batch").collect()
    assert [b.records for b in batches] == [400] * 6 + [100]
    assert [x.url for b in batches for x in b.lines] == [f"u{i:04}" for i in range(2500)]


def test_receipts(spark):
    files = spark.createDataFrame([("a", 3), ("b", 2), ("c", 0)], "task_id string, records long")
    receipts = spark.createDataFrame([("a", 2), ("a", 1)], "task_id string, records long")
    acked, left = G.split_acked(files, receipts)
    assert sorted(r.task_id for r in acked.collect()) == ["a", "c"]
    assert [r.task_id for r in left.collect()] == ["b"]
    assert tuple(G.upload_totals(files, receipts).first()) == (1, 3, 1)
    assert tuple(G.upload_totals(files, receipts.limit(0)).first()) == (0, 0, 2)


def test_reconcile(spark):
    log = _log(spark, [("ok", "u", "saved", 1, None, None), ("bad", "u", "saved", 1, None, None), ("none", "u", "saved", 1, None, None)])
    lines = G.page_lines(log)
    claims = spark.createDataFrame([("ok", 1), ("bad", 2), ("extra", 1)], "task_id string, saved long")
    zero = F.lit(0).cast("long")
    claims = claims.withColumns({"kind": F.lit("_summary"), "rejected": zero, "spooled": zero})
    got = {r.task_id: (r.counted_saved, r.claimed_saved) for r in G.reconcile_log(G.page_log_union(lines, claims)).collect()}
    assert got == {"bad": (1, 2), "none": (1, None), "extra": (None, 1)}


def test_summary_of_failed_task(spark):
    results = spark.createDataFrame(
        [("a", "failed", 5, 0, 9), ("b", "succeeded", 2, 1, 9)],
        "task_id string, status string, pages_crawled long, errors long, elapsed_ms long",
    )
    log = _log(spark, [("a", "u", "spooled", 1, None, None)])
    got = {r.task_id: r for r in G.summary_lines(results, log).collect()}
    assert (got["a"].pages_crawled, got["a"].errors, got["a"].elapsed_ms, got["a"].spooled) == (0, 1, 0, 1)
    assert (got["b"].pages_crawled, got["b"].errors, got["b"].elapsed_ms, got["b"].saved) == (2, 1, 9, 0)


def test_rescrape_latest_failures_in_chunks(spark):
    rows = [("t", f"u{i}", "spooled", 1, None, None) for i in range(5)]
    rows += [("t", "u0", "saved", 2, None, None), ("v", "x", "rejected", 1, None, None), ("v", "y", "error", 1, None, None)]
    got = {r.id: r.payload.pages for r in G.rescrape_failed(_log(spark, rows), size=3).collect()}
    assert got == {"t#0": ["u1", "u2", "u3"], "t#1": ["u4"], "v#0": ["y"]}


def test_liveness(spark):
    beats = spark.sql(
        "SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('b', timestamp'2024-01-01 00:00:59'),"
        "('a', timestamp'2024-01-01 00:00:20') t(node, ts)"
    )
    assert {r.node: r.alive for r in G.node_liveness(beats, 30).collect()} == {"a": False, "b": True}
    assert {r.node: r.alive for r in G.node_liveness(beats, 30, now="2024-01-01 00:00:50").collect()} == {"a": True, "b": True}


def test_spool_formats(spark, tmp_path):
    page = {"url": "u", "html": "<p>"}
    folder = tmp_path / ".page-spool"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"task_id": "t", "page": page}))
    (folder / "2.json.tmp").write_text(json.dumps({"task_id": "x", "page": page}))
    rows = SP.read_spool(spark, str(folder), json=True)
    assert [(r.task_id, r.page.url) for r in rows.collect()] == [("t", "u")]
    SP.write_spool(rows, str(tmp_path / "table"))
    SP.write_spool(rows, str(tmp_path / "table"))
    assert SP.read_spool(spark, str(tmp_path / "table")).count() == 2
