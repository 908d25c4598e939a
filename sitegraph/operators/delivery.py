"""Delivery accounting: retries folded to one verdict per page, and flushes of the spool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.functions.delivery import BACKOFF_SECONDS, dead_letter_class, is_retryable, server_verdict

RETRIES = 3
FLUSH_LIMIT = 100


def final_response(responses: DataFrame) -> DataFrame:
    """Of (fetch_id, attempt, http_status): attempt 2 where attempt 1 was retryable, else attempt 1."""
    first = F.min(F.when(F.col("attempt") == 1, F.col("http_status")))
    second = F.min(F.when(F.col("attempt") == 2, F.col("http_status")))
    folded = responses.groupBy("fetch_id").agg(first.alias("_first"), second.alias("_second"))
    again = is_retryable(F.col("_first")) & F.col("_second").isNotNull()
    return folded.select(
        "fetch_id",
        F.when(again, F.col("_second")).otherwise(F.col("_first")).alias("http_status"),
        again.alias("retried"),
    )


def fold_attempts(attempts: DataFrame, retries: int = RETRIES, key: str = "page_key") -> DataFrame:
    """Per page: the first of at most `retries` attempts that did not fail decides, else `spooled`.

    backoff_seconds is what was waited before the deciding attempt: 0.5 s, doubled each time. All
    buffers are numbers, so this is one hash aggregate: the deciding attempt carries its verdict in
    the lowest bit, and failed attempts are kept as bits, whose value below the deciding attempt is
    the sum of the doublings.
    """
    used = attempts.where(F.col("attempt").between(1, retries))
    answered = "verdict <> 'failed'"
    folded = used.groupBy(key).agg(
        F.expr(f"min(CASE WHEN {answered} THEN attempt * 2L + if(verdict = 'saved', 0, 1) END)").alias("_first"),
        F.expr(f"bit_or(CASE WHEN {answered} THEN 0L ELSE shiftleft(1L, cast(attempt - 1 AS int)) END)").alias("_failed"),
    )
    outcome = "CASE WHEN _first IS NULL THEN 'spooled' WHEN _first % 2 = 0 THEN 'saved' ELSE 'rejected' END"
    last = f"cast(coalesce(_first div 2, {retries}) AS int)"
    return folded.selectExpr(
        key,
        f"{outcome} AS outcome",
        "_first div 2 AS deciding_attempt",
        f"(_failed & (shiftleft(1L, {last} - 1) - 1)) * cast({BACKOFF_SECONDS} AS double) AS backoff_seconds",
    )


def verdict_counts(log: DataFrame, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    return log.groupBy(*keys).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("saved", "rejected", "spooled")]
    )


def flush_batch(spool: DataFrame, limit: int | None = FLUSH_LIMIT) -> DataFrame:
    """The pages one flush offers again: the oldest `limit`, or all."""
    if limit is None:
        return spool
    return spool.orderBy("spooled_at", "spool_id").limit(limit)


def flush_spool(spool: DataFrame, replies: DataFrame, limit: int | None = FLUSH_LIMIT) -> DataFrame:
    """Outcome of each page of one flush: recovered, rejected, dropped or remaining.

    `replies(spool_id, has_reply, saved, message, status_code)` holds the server's answers; a
    message marks a failed delivery. Pages without an answer remain.
    """
    offered = flush_batch(spool, limit)
    answered = offered.join(replies.withColumn("_answered", F.lit(True)), "spool_id", "left")
    verdict = server_verdict(F.coalesce(F.col("has_reply"), F.lit(False)), F.col("saved"))
    failed = F.col("message").isNotNull() | F.col("status_code").isNotNull()
    gone = dead_letter_class(F.col("message"), F.col("status_code")) == "dropped"
    outcome = (
        F.when(F.col("_answered").isNull(), "remaining")
        .when(failed & gone, "dropped")
        .when(failed, "remaining")
        .when(verdict == "saved", "recovered")
        .otherwise("rejected")
    )
    return answered.select(*spool.columns, outcome.alias("flush_outcome"))


def flush_totals(flushed: DataFrame) -> DataFrame:
    return flushed.agg(
        *[
            F.count_if(F.col("flush_outcome") == o).alias(o)
            for o in ("recovered", "rejected", "dropped", "remaining")
        ]
    )
