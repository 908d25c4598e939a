"""Delivery rules, attempt folding and flushes."""

from pyspark.sql import functions as F

from sitegraph.functions import delivery as D
from sitegraph.operators.delivery import final_response, flush_spool, flush_totals, fold_attempts, verdict_counts


def test_retry_wait(spark):
    cases = [
        (None, 2.0), ("", 2.0), ("  ", 2.0), ("1.5", 1.5), (" 3 ", 3.0), ("120", 8.0), ("-3", 0.0), ("3d", 2.0),
        ("1_0", 2.0), (".5", 0.5), ("2e0", 2.0), ("Wed, 21 Oct 2026 07:28:00 GMT", 2.0), ("1.2.3", 2.0),
    ]
    df = spark.createDataFrame(cases, "v string, want double")
    got = df.select("*", D.retry_wait(F.col("v")).alias("got"), D.retry_wait(F.col("v"), 1.0).alias("low")).collect()
    assert all(r.got == r.want for r in got), got
    assert all(r.low == min(r.want, 1.0) for r in got)


def test_dead_letters(spark):
    cases = [
        ("409: Task NOT ASSIGNED", None, "dropped"),
        ("404: page", None, "dropped"),
        ("task not found", None, "dropped"),
        ("read timed out", None, "keep"),
        (None, None, "keep"),
        ("request to /tasks/t404/page failed", 500, "keep"),
        ("gone", 404, "dropped"),
    ]
    df = spark.createDataFrame(cases, "m string, code int, want string")
    got = df.select("want", D.dead_letter_class(F.col("m"), F.col("code")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_attempts(spark):
    rows = [
        ("a", 1, "saved"),
        ("b", 1, "failed"), ("b", 2, "rejected"),
        ("c", 1, "failed"), ("c", 2, "failed"), ("c", 3, "saved"),
        ("d", 1, "failed"), ("d", 2, "failed"), ("d", 3, "failed"),
        ("e", 1, "failed"), ("e", 2, "failed"), ("e", 3, "failed"), ("e", 4, "saved"),
        ("f", 1, "saved"), ("f", 2, "failed"),
    ]
    df = spark.createDataFrame(rows, "page_key string, attempt int, verdict string")
    got = {r.page_key: (r.outcome, r.backoff_seconds) for r in fold_attempts(df).collect()}
    assert got == {
        "a": ("saved", 0.0), "b": ("rejected", 0.5), "c": ("saved", 1.5),
        "d": ("spooled", 1.5), "e": ("spooled", 1.5), "f": ("saved", 0.0),
    }
    plan = fold_attempts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan


def test_second_response_is_final(spark):
    rows = [(1, 1, 200), (2, 1, 503), (2, 2, 200), (3, 1, 429), (3, 2, 503), (4, 1, 404), (4, 2, 200), (5, 1, 503)]
    got = {
        r.fetch_id: (r.http_status, r.retried)
        for r in final_response(spark.createDataFrame(rows, "fetch_id int, attempt int, http_status int")).collect()
    }
    assert got == {1: (200, False), 2: (200, True), 3: (503, True), 4: (404, False), 5: (503, False)}


def test_flush_and_counts(spark):
    spool = spark.range(300).select(F.col("id").alias("spool_id"), (1000 - F.col("id")).alias("spooled_at"))
    replies = spool.select(
        "spool_id",
        (F.col("spool_id") % 2 == 0).alias("has_reply"),
        (F.col("spool_id") % 4 == 0).alias("saved"),
        F.when(F.col("spool_id") % 2 == 1, "404").alias("message"),
        F.lit(None).cast("int").alias("status_code"),
    )
    first = flush_spool(spool, replies)
    assert first.count() == 100 and first.agg(F.min("spool_id")).first()[0] == 200
    assert tuple(flush_totals(flush_spool(spool, replies, None)).first()) == (75, 75, 150, 0)
    nothing = flush_spool(spool, replies.limit(0), None)
    assert tuple(flush_totals(nothing).first()) == (0, 0, 0, 300)
    log = spark.createDataFrame([("t", "saved"), ("t", "saved"), ("t", "spooled"), ("u", "error")], "task_id string, outcome string")
    assert {tuple(r) for r in verdict_counts(log).collect()} == {("t", 2, 0, 1), ("u", 0, 0, 0)}
