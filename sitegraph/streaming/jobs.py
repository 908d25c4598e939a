"""The stream forms of ingest, counting, throttling, log tailing and spool retry.

Each function takes a streaming DataFrame and returns a DataStreamWriter with trigger and checkpoint
still open, or takes paths and starts nothing else. Sinks written from `foreachBatch` put every
micro-batch into its own `batch_id` directory and overwrite it on a replay, so a restarted query
leaves no duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupStateTimeout

from sitegraph.operators.delivery import flush_spool
from sitegraph.operators.progress import throttle_progress
from sitegraph.session import cut, hadoop_path

LATE = "10 minutes"
#: Milliseconds of arrivals without a ping after which a task's throttle state goes.
IDLE_MS = 6 * 3600 * 1000
#: Groups of tasks whose throttle states are kept together; a checkpoint holds on to the number it began with.
TASK_BUCKETS = 1024


def write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process all input that is there now, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def page_ingest(pages: DataFrame, sink: str, spool: str, late: str = LATE) -> DataStreamWriter:
    """Deliver each (task_id, url) once: saved and rejected pages to `sink`, undelivered ones to `spool`.

    `pages` has task_id, url, ts, outcome and the page's columns. A copy that arrives more than
    `late` after the first counts as a new page; older rows are dropped. Delivered and undelivered
    copies are told apart, so a page first spooled and then saved reaches both places once.
    """
    lost = F.col("outcome") == "spooled"
    marked = pages.withWatermark("ts", late).withColumn("_lost", lost)
    once = marked.dropDuplicatesWithinWatermark(["task_id", "url", "_lost"]).drop("_lost")

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        write_batch(batch.where(~lost), batch_id, sink)
        write_batch(batch.where(lost), batch_id, spool)
        batch.unpersist()

    return once.writeStream.foreachBatch(deliver)


def outcome_counts(log: DataFrame, window: str = "1 hour", late: str = LATE) -> DataFrame:
    """saved, rejected and spooled per task and window, for `write_counts`; windows stay open until the watermark passes."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "task_id")
        .agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("saved", "rejected", "spooled")])
        .select("task_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"),
                "saved", "rejected", "spooled")
    )


def write_counts(counts: DataFrame, out: str) -> DataStreamWriter:
    """Each micro-batch writes the windows it changed, those still open included; `read_counts` takes the last of each."""
    return counts.writeStream.outputMode("update").foreachBatch(lambda b, i: write_batch(b, i, out))


def read_counts(written: DataFrame) -> DataFrame:
    """The latest counts per task and window of what `write_counts` wrote."""
    values = F.struct("saved", "rejected", "spooled")
    latest = written.groupBy("task_id", "start", "end").agg(F.max_by(values, "batch_id").alias("v"))
    return latest.select("task_id", "start", "end", "v.*")


def progress_throttle(pings: DataFrame, out: str, seconds: float = 1.0, idle_ms: int = IDLE_MS) -> DataStreamWriter:
    """`throttle_progress` over micro-batches, with the last kept time of each task in Spark's state store.

    Tasks (NULL is a task like any other) are hashed into `TASK_BUCKETS`, the keys of
    `applyInPandasWithState`: what a call costs besides its rows is paid per bucket, not per task. A
    micro-batch reads and writes the state of the buckets it has pings for, nothing else. Each row is stamped
    with the time its micro-batch started, and a watermark on that stamp drives an event-time timeout: a task
    leaves its bucket, and a bucket without tasks the store, once no ping has arrived for `idle_ms`, so the
    store holds the tasks of recent arrivals, not all tasks ever seen. A late ping takes part at the time of
    the last kept one, but keeps its own `ts` in the output; a ping of a task whose state has gone starts it
    anew. Within a micro-batch a bucket's pings meet in one group, so a batch's size bounds the largest group.
    Kept pings go to `out`, one folder per micro-batch, overwritten on a replay.
    """
    wait = int(seconds * 1_000_000)
    columns = pings.columns
    stamped = pings.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "0 seconds")
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(TASK_BUCKETS)).cast("int")
    kept = stamped.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(
        lambda key, frames, state: _throttled(frames, state, wait, idle_ms),
        stamped.schema,
        "tasks array<string>, lasts array<long>, until array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return kept.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch.select(*columns), batch_id, out))


def _throttled(frames, state, wait: int, idle_ms: int):
    """The kept pings of a bucket; its state is each task's last kept time and the time it is forgotten at."""
    import numpy as np
    import pandas as pd

    known = dict(zip(state.get[0], zip(state.get[1], state.get[2]))) if state.exists else {}
    now = max(0, state.getCurrentWatermarkMs())
    rows, picked = [], None
    if not state.hasTimedOut:
        rows = pd.concat(list(frames), ignore_index=True).drop(columns="_bucket")
        known |= {t: (known[t][0], now + idle_ms) for t in map(_task, rows["task_id"].unique()) if t in known}
        rows = rows[rows["total"].fillna(1) > 1]
    if len(rows):
        us = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        codes, names = pd.factorize(rows["task_id"], use_na_sentinel=False)
        order = np.lexsort((rows["done"].to_numpy(np.float64, na_value=np.nan), us, codes))
        rows, codes = rows.iloc[order], codes[order]
        arrived = max(int(rows["_arrived"].astype("datetime64[ms]").astype("int64").max()), now)
        starts = np.flatnonzero(np.diff(codes, prepend=-1)).tolist()
        times, dones, totals = us[order].tolist(), rows["done"].tolist(), rows["total"].tolist()
        keep = np.zeros(len(rows), bool)
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            task = _task(names[codes[a]])
            last = known[task][0] if task in known else None
            for k in range(a, b):
                at = times[k] if last is None else max(times[k], last)
                done, total = dones[k], totals[k]
                if last is None or at - last >= wait or (done == done and total == total and done == total):
                    keep[k] = True
                    last = at
            known[task] = (last, arrived + idle_ms)
        picked = rows[keep]
    left = {t: v for t, v in known.items() if v[1] >= now}
    if left:
        lasts, until = zip(*left.values())
        state.update((list(left), list(lasts), list(until)))
        state.setTimeoutTimestamp(max(1, min(until)))
    elif state.exists:
        state.remove()
    if picked is not None and len(picked):
        yield picked


def _task(name) -> str | None:
    return name if isinstance(name, str) else None


def log_tail(lines: DataFrame, out: str) -> DataStreamWriter:
    """Append log lines as their files land; `lines` comes from `sources.logs.stream_log`."""
    return lines.writeStream.format("parquet").option("path", out).outputMode("append")


def spool_retry(
    spool: DataFrame, replies: DataFrame, out: str, state: str, limit: int | None = None
) -> DataStreamWriter:
    """Offer spooled pages again per micro-batch and write the outcome of each that is settled.

    Pages beyond `limit`, without an answer, or that failed for the time being are kept in `state` and
    offered again with the next micro-batch, the oldest first; `out` gets recovered, rejected and
    dropped pages only. State of batch n is written whole and overwritten on a replay. `read_spool_left`
    gives what still waits; `flush_left` offers it once more when no new pages arrive.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting = batch
        if batch_id > 0:
            before = spark.read.schema(batch.schema).parquet(f"{state}/batch_id={batch_id - 1}")
            waiting = batch.unionByName(before)
        # a page spooled twice is one page
        _flush_once(waiting.dropDuplicates(["spool_id"]), replies, limit, batch_id, out, state)

    return spool.writeStream.foreachBatch(flush)


def _flush_once(waiting: DataFrame, replies: DataFrame, limit: int | None, batch_id: int, out: str, state: str) -> None:
    flushed = flush_spool(waiting, replies, limit).persist()
    settled = flushed.where("flush_outcome <> 'remaining'")
    write_batch(settled, batch_id, out)
    left = waiting.join(settled.select("spool_id"), "spool_id", "left_anti").select(*waiting.columns)
    write_batch(left, batch_id, state)
    flushed.unpersist()


def last_state(spark: SparkSession, state: str) -> int | None:
    """Number of the last micro-batch in a state folder."""
    folder, fs = hadoop_path(spark, state)
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n.partition("=")[2]) for n in names if n.startswith("batch_id=")), default=None)


def read_spool_left(spark: SparkSession, state: str, schema) -> DataFrame:
    """Pages that still wait after the last micro-batch."""
    last = last_state(spark, state)
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{state}/batch_id={last}")


def flush_left(spark: SparkSession, replies: DataFrame, out: str, state: str, schema, limit: int | None = None) -> None:
    """Offer what waits once more, outside the stream; its results take the place of the last micro-batch's state.

    Run between runs of the stream. The settled pages are written beside those of that micro-batch.
    """
    last = last_state(spark, state)
    if last is None:
        return
    left = cut(read_spool_left(spark, state, schema))
    flushed = cut(flush_spool(left, replies, limit))
    settled = flushed.where("flush_outcome <> 'remaining'")
    settled.write.mode("append").parquet(f"{out}/batch_id={last}")
    write_batch(left.join(settled.select("spool_id"), "spool_id", "left_anti").select(*left.columns), last, state)


def last_heartbeats(heartbeats: DataFrame, out: str, late: str = LATE) -> DataStreamWriter:
    """Latest heartbeat per node, in update mode; each micro-batch writes the nodes it moved."""
    last = heartbeats.withWatermark("ts", late).groupBy("node").agg(F.max("ts").alias("ts"))
    return last.writeStream.outputMode("update").foreachBatch(lambda b, i: write_batch(b, i, out))
