"""Scalar rules of page delivery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph.functions.html import strip

# Statuses retried once, waits in seconds, and messages that end a retry.
RETRY_STATUSES = (429, 503)
RETRY_CAP = 8.0
RETRY_DEFAULT = 2.0
GONE_MESSAGES = ("not assigned", "not found", "404")
BACKOFF_SECONDS = 0.5


def is_retryable(http_status: Column) -> Column:
    return F.coalesce(http_status.isin(*RETRY_STATUSES), F.lit(False))


def retry_wait(retry_after: Column, cap: float = RETRY_CAP) -> Column:
    """Seconds to wait: a number clamped to 0..cap, the default when missing or not a number."""
    text = strip(retry_after)
    number = F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    # greatest and least skip NULL, so the default comes first.
    wait = F.coalesce(number, F.lit(RETRY_DEFAULT))
    return F.greatest(F.lit(0.0), F.least(wait, F.lit(float(cap))))


def server_verdict(has_reply: Column, saved: Column) -> Column:
    """`saved` unless the server replied without confirming it."""
    return F.when(~has_reply | F.coalesce(saved, F.lit(False)), "saved").otherwise("rejected")


def dead_letter_class(message: Column, status_code: Column | None = None) -> Column:
    """`dropped` when the task is gone for good, else `keep`.

    The message alone can mislead (it may quote a path with 404 in it), so a status code decides
    when there is one.
    """
    low = F.lower(F.coalesce(message, F.lit("")))
    by_text = low.contains(GONE_MESSAGES[0]) | low.contains(GONE_MESSAGES[1]) | low.contains(GONE_MESSAGES[2])
    if status_code is None:
        gone = by_text
    else:
        gone = F.coalesce(status_code == 404, by_text)
    return F.when(gone, "dropped").otherwise("keep")
