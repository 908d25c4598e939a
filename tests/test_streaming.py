"""Streams against their batch twins; a restarted query leaves no duplicates."""

import json

from pyspark.sql import functions as F

from sitegraph.operators.delivery import flush_totals
from sitegraph.operators.progress import throttle_progress
from sitegraph.sources import logs as S
from sitegraph.streaming import jobs as J

PINGS = "task_id string, ts timestamp, done long, total long"


def test_throttle_over_restarts(spark, tmp_path):
    rows = [(t, 10.0 * b + s, 20 * b + i + 1, 60) for t in "ab" for b in range(3) for i, s in enumerate(x * 0.45 for x in range(20))]
    pings = spark.createDataFrame(rows, "task_id string, s double, done long, total long").select(
        "task_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "done", "total"
    )
    for b in range(3):
        pings.where(F.col("done").between(20 * b + 1, 20 * b + 20)).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(PINGS).parquet(str(tmp_path / "in"))
        writer = J.progress_throttle(stream, str(tmp_path / "out"), 1.0)
        J.run_available(writer, str(tmp_path / "ck"))
    got = spark.read.schema(PINGS).parquet(str(tmp_path / "out"))
    want = throttle_progress(pings, 1.0)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_throttle_ignores_late_pings(spark, tmp_path):
    def arrive(rows):
        df = spark.createDataFrame(rows, "task_id string, s long, done long, total long")
        df.select("task_id", F.timestamp_seconds("s").alias("ts"), "done", "total").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(PINGS).parquet(str(tmp_path / "in"))
        J.run_available(J.progress_throttle(stream, str(tmp_path / "out"), 5.0), str(tmp_path / "ck"))

    arrive([("a", 100, 1, 9), ("a", 107, 2, 9)])
    arrive([("a", 101, 3, 9), ("a", 110, 4, 9), ("a", 112, 5, 9), ("b", 1, 1, 9)])
    arrive([("a", 113, 9, 9)])
    kept = spark.read.schema(PINGS).parquet(str(tmp_path / "out")).collect()
    assert {r.done: r.ts.second for r in kept if r.task_id == "a"}[5] == 112 - 60
    assert sorted((r.task_id, r.done) for r in kept) == [("a", 1), ("a", 2), ("a", 5), ("a", 9), ("b", 1)]


def test_ingest_once(spark, tmp_path):
    rows = [("t", f"u{i % 7}", i, "spooled" if i % 7 == 0 else "saved") for i in range(40)]
    pages = spark.createDataFrame(rows, "task_id string, url string, s long, outcome string")
    pages = pages.select("task_id", "url", F.timestamp_seconds("s").alias("ts"), "outcome")
    for part in (pages.where("second(ts) < 20"), pages.where("second(ts) >= 20")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
            writer = J.page_ingest(stream, str(tmp_path / "pages"), str(tmp_path / "spool"))
            J.run_available(writer, str(tmp_path / "ck"))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "pages")).collect()) == [f"u{i}" for i in range(1, 7)]
    assert [r.url for r in spark.read.parquet(str(tmp_path / "spool")).collect()] == ["u0"]


def test_late_pings_keep_their_time(spark, tmp_path):
    def arrive(rows):
        df = spark.createDataFrame(rows, "task_id string, s long, done long, total long")
        df.select("task_id", F.timestamp_seconds("s").alias("ts"), "done", "total").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(PINGS).parquet(str(tmp_path / "in"))
        J.run_available(J.progress_throttle(stream, str(tmp_path / "out"), 5.0), str(tmp_path / "ck"))

    arrive([("a", 120, 1, 9)])
    arrive([("a", 110, 9, 9)])  # completes the task, but comes late
    kept = spark.read.schema(PINGS).parquet(str(tmp_path / "out")).select("done", F.unix_seconds("ts")).collect()
    assert sorted(map(tuple, kept)) == [(1, 120), (9, 110)]


def test_a_spooled_page_that_is_saved_later(spark, tmp_path):
    for s, outcome in ((1, "spooled"), (2, "saved"), (3, "saved")):
        page = spark.createDataFrame([("t", "u", s, outcome)], "task_id string, url string, s long, outcome string")
        page = page.select("task_id", "url", F.timestamp_seconds("s").alias("ts"), "outcome")
        page.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(page.schema).parquet(str(tmp_path / "in"))
        J.run_available(J.page_ingest(stream, str(tmp_path / "pages"), str(tmp_path / "spool")), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 1 == spark.read.parquet(str(tmp_path / "spool")).count()


def test_tail_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "logs" / "_unfiled" / "w"
    folder.mkdir(parents=True)
    line = json.dumps({"kind": "page", "task_id": "t", "url": "u", "outcome": "saved"})
    for name in ("a", "b"):
        (folder / f"{name}.jsonl").write_text(f"{line}\n{{bad\n\n5\n")
        stream = S.stream_log(spark, str(tmp_path / "logs"))
        J.run_available(J.log_tail(stream, str(tmp_path / "out")), str(tmp_path / "ck"))
    tailed = spark.read.parquet(str(tmp_path / "out"))
    assert tailed.count() == 2 == S.read_log(spark, str(tmp_path / "logs")).count()


def test_spool_retry_until_nothing_is_left(spark, tmp_path):
    spool = spark.range(10).select(F.col("id").alias("spool_id"), F.col("id").alias("spooled_at"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    busy = F.when(F.col("spool_id") == 3, F.lit("503: later"))

    def replies(message):
        return spool.select(
            "spool_id", F.lit(True).alias("has_reply"), F.lit(True).alias("saved"), message.cast("string").alias("message"),
            F.lit(None).cast("int").alias("status_code"),
        )

    def settled():
        rows = [r.spool_id for r in spark.read.parquet(out).collect()]
        return sorted(rows) if len(rows) == len(set(rows)) else rows

    for first in (0, 6):
        spool.where(F.col("spool_id").between(first, first + (5 if first == 0 else 3))).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spool.schema).parquet(str(tmp_path / "in"))
        J.run_available(J.spool_retry(stream, replies(busy), out, state, limit=4), str(tmp_path / "ck"))
    assert settled() == [0, 1, 2, 4, 5, 6]  # 3 failed for now, 4 and 5 waited a batch, 7 to 9 still do
    assert sorted(r.spool_id for r in J.read_spool_left(spark, state, spool.schema).collect()) == [3, 7, 8, 9]
    J.flush_left(spark, replies(F.lit(None)), out, state, spool.schema, limit=4)
    assert settled() == list(range(10)) and J.read_spool_left(spark, state, spool.schema).count() == 0
    assert flush_totals(spark.read.parquet(out)).first().recovered == 10


def test_throttle_state_holds_tasks_in_progress(spark, tmp_path):
    """New tasks in every micro-batch: completed ones leave the state; a NULL task is throttled across batches."""
    for b in range(20):
        rows = [(f"t{b}", 10 * b + k, k, 4) for k in range(1, 5)] + [(None, 100 * b, b + 1, 99)]
        df = spark.createDataFrame(rows, "task_id string, s long, done long, total long")
        one = df.select("task_id", F.timestamp_seconds("s").alias("ts"), "done", "total").coalesce(1)
        one.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(PINGS).parquet(str(tmp_path / "in"))
    query = J.progress_throttle(stream, str(tmp_path / "out"), 150.0, idle_ms=0).option("checkpointLocation", str(tmp_path / "ck"))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) <= 3  # the NULL task, the task of this trigger and that of the one before
    kept = spark.read.schema(PINGS).parquet(str(tmp_path / "out")).collect()
    # the NULL task has a ping in every trigger, so its state stays and its pings are throttled throughout
    assert sorted(r.done for r in kept if r.task_id is None) == list(range(1, 21, 2))
    assert len([r for r in kept if r.task_id is not None]) == 20 * 2  # first ping, and the one that completes


def test_throttle_state_lingers_for_late_pings(spark, tmp_path):
    def arrive(rows):
        df = spark.createDataFrame(rows, "task_id string, s long, done long, total long")
        df.select("task_id", F.timestamp_seconds("s").alias("ts"), "done", "total").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(PINGS).parquet(str(tmp_path / "in"))
        J.run_available(J.progress_throttle(stream, str(tmp_path / "out"), 5.0), str(tmp_path / "ck"))

    arrive([(None, 100, 1, 9), (None, 101, 9, 9)])
    arrive([(None, 102, 3, 9)])  # after the completing ping, within the idle time: throttled, not anew
    kept = spark.read.schema(PINGS).parquet(str(tmp_path / "out")).collect()
    assert sorted(r.done for r in kept) == [1, 9]


def test_throttle_state_is_kept_by_bucket(spark, tmp_path):
    """The store's rows, and the calls for them, do not grow with the tasks beyond the buckets."""
    tasks = 3 * J.TASK_BUCKETS
    for b in range(2):
        rows = spark.range(tasks).select(
            F.concat(F.lit("t"), "id").alias("task_id"), F.timestamp_seconds(F.col("id") + 4 * b).alias("ts"),
            F.lit(b + 1).cast("long").alias("done"), F.lit(9).cast("long").alias("total"),
        )
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(PINGS).parquet(str(tmp_path / "in"))
    query = J.progress_throttle(stream, str(tmp_path / "out"), 5.0).option("checkpointLocation", str(tmp_path / "ck"))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(states) <= J.TASK_BUCKETS
    kept = spark.read.schema(PINGS).parquet(str(tmp_path / "out"))
    assert kept.groupBy("done").count().collect() == [(1, tasks)]  # four seconds later is too soon for all


def test_throttle_of_tasks_that_share_a_bucket(spark, tmp_path, monkeypatch):
    """Each task is throttled for itself, and leaves the bucket when it is idle though the bucket is not."""
    monkeypatch.setattr(J, "TASK_BUCKETS", 1)
    batches = [
        [("a", 100, 1, 9), ("b", 103, 1, 9), (None, 104, 1, 9), ("c", 1, 1, 1), ("a", 104, 2, 9), ("b", 108, 2, None)],
        [("b", 109, 3, 9), (None, 110, 2, 9), (None, 110, 9, 9)],
        [("b", 112, 4, 9), (None, 112, 3, 9)],
        [("b", 120, 5, 9), (None, 113, 4, 9)],
        [("b", 121, 9, 9), ("a", 104, 3, 9)],  # a was idle for three batches and starts anew
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, "task_id string, s long, done long, total long")
        one = df.select("task_id", F.timestamp_seconds("s").alias("ts"), "done", "total").coalesce(1)
        one.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(PINGS).parquet(str(tmp_path / "in"))
        J.run_available(J.progress_throttle(stream, str(tmp_path / "out"), 5.0, idle_ms=1), str(tmp_path / "ck"))
    kept = spark.read.schema(PINGS).parquet(str(tmp_path / "out")).collect()
    by = {t: sorted(r.done for r in kept if r.task_id == t) for t in ("a", "b", "c", None)}
    assert by == {"a": [1, 3], "b": [1, 3, 5, 9], "c": [], None: [1, 2, 9]}
