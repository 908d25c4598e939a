"""Explicit schemas of every record kind; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


STR, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()

PAYLOAD = _struct(
    url=STR,
    pages=T.ArrayType(STR),
    max_pages=INT,
    client_id=STR,
    lead_id=STR,
    website_id=STR,
    user_id=STR,
    redis_job_id=STR,
)

TASK = _struct(id=STR, task_type=STR, payload=PAYLOAD)

SPOOLED_PAGE = _struct(
    url=STR, final_url=STR, http_status=INT, title=STR, content_length=LONG, elapsed_ms=LONG, html=STR
)

SPOOL = _struct(task_id=STR, spooled_at=LONG, page=SPOOLED_PAGE)

# Page lines and summary lines share one log; each kind leaves the other's columns NULL.
IDENTITY = ("task_id", "task_type", "client_id", "lead_id", "website_id", "user_id", "redis_job_id", "start_url")

LOG_LINE = _struct(
    ts=LONG,
    node=STR,
    **{name: STR for name in IDENTITY},
    kind=STR,
    url=STR,
    outcome=STR,
    reason=STR,
    http_status=INT,
    bytes=LONG,
    title=STR,
    status=STR,
    saved=LONG,
    rejected=LONG,
    spooled=LONG,
    pages_crawled=LONG,
    errors=LONG,
    elapsed_ms=LONG,
)
