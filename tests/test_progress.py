"""Throttling, numbering and running totals against sequential models."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sitegraph.operators.progress import rows_in_chunks, throttle_progress
from sitegraph.operators.running import Running, range_buckets, running

SCHEMA = "task_id string, us long, done long, total long"


def sequential(pings, wait):
    kept, last = [], {}
    for task, us, done, total in sorted(pings, key=lambda p: (p[0], p[1], p[2])):
        if (total or 1) <= 1:
            continue
        if task not in last or us - last[task] >= wait or done == total:
            last[task] = us
            kept.append((task, us, done, total))
    return sorted(kept)


@pytest.fixture(scope="module")
def pings():
    rnd = random.Random(9)
    rows = []
    for task in range(12):
        # Task 0 holds most pings; steps range from dense to sparse.
        n, step = (2500, 120_000) if task == 0 else (rnd.randint(1, 90), rnd.choice([50_000, 400_000, 1_500_000]))
        us = 1_700_000_000_000_000
        total = n if task % 3 else n + 5
        for done in range(1, n + 1):
            us += rnd.choice([0, step, rnd.randint(0, 2 * step)])
            rows.append((str(task), us, done, total if task != 4 else 1))
    return rows


def test_throttle_equals_sequential_rule(spark, pings, many_partitions):
    df = spark.createDataFrame(pings, SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    kept = throttle_progress(df, 1.0).select("task_id", "us", "done", "total")
    assert sorted(map(tuple, kept.collect())) == sequential(pings, 1_000_000)


def test_running_totals_of_a_hot_key(spark, many_partitions):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.7 else f"k{i % 5}", i, rnd.randint(0, 9)) for i in range(3000)]
    df = range_buckets(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], ["o"])
    outs = [Running("s", F.col("v")), Running("m", F.col("v"), "max", inclusive=False), Running("n", F.lit(1))]
    got = running(df, ["k"], F.col("range_bucket"), [F.col("o")], outs).collect()
    assert len({r.range_bucket for r in got if r.k == "hot"}) > 1
    sums, tops, counts = defaultdict(int), {}, defaultdict(int)
    for r in sorted(got, key=lambda r: (r.k, r.o)):
        assert r.m == tops.get(r.k)
        sums[r.k] += r.v
        counts[r.k] += 1
        tops[r.k] = max(r.v, tops.get(r.k, r.v))
        assert (r.s, r.n) == (sums[r.k], counts[r.k])
    assert len(got) == len(rows)


def test_running_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, o long")
    got = running(df, ["k"], F.floor(F.col("o") / 2), [F.col("o")], [Running("n", F.lit(1))]).collect()
    assert sorted((r.k or "", r.n) for r in got) == [("", 1), ("", 2), ("a", 1)]


def test_chunks(spark, many_partitions):
    df = spark.range(1005).select(F.when(F.col("id") < 1000, "hot").otherwise("cold").alias("k"), "id")
    got = rows_in_chunks(df, "k", ["id"], 100).groupBy("k", "chunk").agg(F.count("*").alias("n"), F.min("id"), F.max("pos"))
    sizes = {(r.k, r.chunk): (r.n, r["min(id)"], r["max(pos)"]) for r in got.collect()}
    assert sizes == {**{("hot", i): (100, i * 100, 99) for i in range(10)}, ("cold", 0): (5, 1000, 4)}


def test_throttle_keeps_pings_of_a_null_task(spark, pings, many_partitions):
    """A NULL task_id is one task: its pings are throttled, not lost; one task holds a third of all pings."""
    rnd = random.Random(4)
    extra, us = [], 1_700_000_000_000_000
    for done in range(1, 1601):
        us += rnd.choice([0, 200_000, 900_000, 2_500_000])
        extra.append((None, us, done, 1600))
    rows = pings + extra
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    kept = throttle_progress(df, 1.0).select("task_id", "us", "done", "total").collect()
    key = lambda p: ("" if p[0] is None else "~" + p[0], p[1], p[2])
    want = sorted(sequential([(t or "", u, d, n) for t, u, d, n in rows], 1_000_000), key=key)
    got = sorted([(r.task_id or "", r.us, r.done, r.total) for r in kept], key=key)
    assert got == want and any(t == "" for t, *_ in got)


def test_throttle_of_equal_times_and_a_long_wait(spark, many_partitions):
    rows = [("a", 5, d, 9) for d in range(1, 10)] + [("b", 10**6 * k, k, 40) for k in range(1, 41)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    kept = throttle_progress(df, 7.5).select("task_id", "us", "done", "total").collect()
    assert sorted(map(tuple, kept)) == sequential(rows, 7_500_000)
