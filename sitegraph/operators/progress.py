"""Progress pings: at most one per interval and task, measured from the last one let through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.operators.running import number_rows, range_buckets


def throttle_progress(pings: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Keep the first ping of a task, each ping at least `seconds` after the last kept, and done = total.

    Tasks with a single page (total <= 1) send no pings; a NULL task_id is a task like any other.
    Pings are cut into ranges of (task_id, time, done) of about equal size, so a task with a third of
    all pings spans many ranges. Each range is walked once, in order, by a segmented scan:

    1. Inside a range, every ping gets the next ping kept after it (the first at least `seconds`
       later, or the next that completes its task) and, walking backwards, the last ping kept in the
       range if the walk enters at it. The range of a task is thereby a function from the last kept
       time before it to the last kept time after it: a step function of few steps, since a walk can
       only enter at a ping less than `seconds` after the range's first one. Only ranges that go on a
       task of an earlier range send it on.
    2. The functions of a task's ranges are composed in order, which gives each range its entry time.
       A task meets a range boundary at most once per boundary, so these are at most as many rows as
       ranges and are passed to the last step as a table of that size.
    3. Each range is walked again from its entry time and yields the kept pings.

    The ranges are one range partitioning, written once; steps 1 and 3 read it without a shuffle.
    """
    wait = int(seconds * 1_000_000)
    many = pings.where(F.coalesce(F.col("total"), F.lit(1)) > 1)
    timed = many.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    placed = range_buckets(timed, ["task_id"], ["_us", "done"], "_range")
    ordered = placed.sortWithinPartitions(F.col("task_id").asc_nulls_first(), "_us", "done")
    narrow = ordered.select("task_id", "_range", "_us", "done", "total")  # the first walk needs no other column
    summaries = narrow.mapInPandas(lambda it: _range_functions(it, wait), _FUNCTIONS)
    chained = summaries.groupBy("task_id").applyInPandas(lambda key, df: _chain(df, wait), _ENTRIES).collect()
    # at most two rows per range: bounded by the number of partitions, not by the pings
    entries = {(r["task_id"], r["_range"]): r["_in"] for r in chained}
    kept = ordered.mapInPandas(lambda it: _kept_pings(it, wait, entries), placed.schema)
    return kept.select(*pings.columns)


_FUNCTIONS = "task_id string, _range int, _first boolean, _at array<long>, _out array<long>, _fresh long"
_ENTRIES = "task_id string, _range int, _in long"
_NONE = -(1 << 62)


def _walk(us, done, total, wait):
    """(next, first_flag): the next kept ping after each ping, and the first ping that completes its task."""
    import numpy as np

    m = len(us)
    last = np.flatnonzero((done == total) & ~np.isnan(done) & ~np.isnan(total))
    after = np.maximum(np.searchsorted(us, us + wait, side="left"), np.arange(1, m + 1))
    at = np.searchsorted(last, np.arange(1, m + 1), side="left")
    flag_after = np.where(at < len(last), last[np.minimum(at, max(len(last) - 1, 0))] if len(last) else m, m)
    return np.minimum(after, flag_after), (int(last[0]) if len(last) else m)


def _exits(nxt):
    """The last kept ping of a walk that enters at each ping."""
    import numpy as np

    m = len(nxt)
    exit_ = np.arange(m)
    for i in range(m - 1, -1, -1):
        if nxt[i] < m:
            exit_[i] = exit_[nxt[i]]
    return exit_


def _entry(us, first_flag, at, wait):
    """Index of the ping a walk enters at when the last kept time is `at` (None: the first ping)."""
    import numpy as np

    if at is None:
        return 0
    return min(int(np.searchsorted(us, at + wait, side="left")), first_flag)


def _groups(batches):
    """(task_id, range, rows) per run of equal task_id and range in the ordered rows of a partition."""
    import pandas as pd

    carry = None
    for batch in batches:
        frame = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
        if len(frame) == 0:
            continue
        # the rows of a partition share one range: a group ends where the task changes (NULL equal to NULL)
        task, before = frame["task_id"], frame["task_id"].shift()
        change = (task != before) & ~(task.isna() & before.isna())
        change.iloc[0] = True
        cuts = change.to_numpy().nonzero()[0].tolist() + [len(frame)]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield frame.iloc[a:b]
        carry = frame.iloc[cuts[-2] :].reset_index(drop=True)
    if carry is not None and len(carry):
        yield carry


def _arrays(group):
    import numpy as np

    us = group["_us"].to_numpy(dtype=np.int64)
    done = group["done"].to_numpy(dtype=np.float64, na_value=np.nan)
    total = group["total"].to_numpy(dtype=np.float64, na_value=np.nan)
    return us, done, total


def _range_functions(batches, wait):
    """Per partition: the function of its first task (it may go on an earlier range's task) and the last
    kept time of its last task entered fresh (it may go on into the next range)."""
    import pandas as pd

    groups = list(_first_and_last(_groups(batches)))
    rows = []
    for i, g in enumerate(groups):
        us, done, total = _arrays(g)
        nxt, first_flag = _walk(us, done, total, wait)
        exit_ = _exits(nxt)
        task, rng = g["task_id"].iloc[0], int(g["_range"].iloc[0])
        if i == 0:
            head = int(min(len(us) - 1, first_flag, int(__import__("numpy").searchsorted(us, us[0] + wait, side="left"))))
            rows.append((task, rng, True, us[: head + 1].tolist(), us[exit_[: head + 1]].tolist(), int(us[exit_[0]])))
        if i == len(groups) - 1 and i > 0:
            rows.append((task, rng, False, [], [], int(us[exit_[0]])))
    yield pd.DataFrame(rows, columns=["task_id", "_range", "_first", "_at", "_out", "_fresh"])


def _first_and_last(groups):
    """The first and the last group of an iterator, without holding the ones between."""
    first = last = None
    for g in groups:
        if first is None:
            first = g
        last = g
    if first is not None:
        yield first
        if last is not first:
            yield last


def _chain(df, wait):
    """Compose a task's range functions in range order; the entry time of each range after its first."""
    import numpy as np
    import pandas as pd

    df = df.sort_values(["_range", "_first"], ascending=[True, False])
    out, at = [], None
    for _, r in df.drop_duplicates("_range", keep="first").iterrows():
        if at is None:
            at = int(r["_fresh"])
            continue
        out.append((r["task_id"], int(r["_range"]), at))
        if len(r["_at"]):
            ts = np.asarray(r["_at"], dtype=np.int64)
            j = int(np.searchsorted(ts, at + wait, side="left"))
            at = int(r["_out"][j]) if j < len(ts) else at
        else:
            at = int(r["_fresh"])
    return pd.DataFrame(out, columns=["task_id", "_range", "_in"])


def _kept_pings(batches, wait, entries):
    import numpy as np

    for g in _groups(batches):
        us, done, total = _arrays(g)
        nxt, first_flag = _walk(us, done, total, wait)
        task = g["task_id"].iloc[0]
        at = entries.get((None if task is None or task != task else task, int(g["_range"].iloc[0])))
        i = _entry(us, first_flag, at, wait)
        keep = np.zeros(len(us), dtype=bool)
        while i < len(us):
            keep[i] = True
            i = int(nxt[i])
        if keep.any():
            yield g[keep]


def rows_in_chunks(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Number each key's rows and add `chunk`, 0-based, of at most `size` rows."""
    placed = range_buckets(df, [key], order, "_range")
    numbered = number_rows(placed, [key], F.col("_range"), [F.col(c) for c in order], "_n")
    chunk = F.floor((F.col("_n") - 1) / size).cast("long")
    return numbered.withColumn("chunk", chunk).withColumn("pos", F.col("_n") - 1 - chunk * size).drop("_range", "_n")
