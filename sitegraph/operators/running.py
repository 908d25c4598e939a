"""Numbering and running totals that do not put a whole key into one task.

A window over one key runs in one task, and one site or task may hold a third of all rows. Here the
key is cut into buckets that follow the order: each (key, bucket) gets its own window, which starts
from the totals of the earlier buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.session import cut


@dataclass(frozen=True)
class Running:
    """One output column: the sum (or max) of `value` over the rows so far in the key."""

    out: str
    value: Column
    kind: str = "sum"
    inclusive: bool = True

    def over(self, column: str, window) -> Column:
        return (F.sum(column) if self.kind == "sum" else F.max(column)).over(window)

    def total(self, column: str) -> Column:
        return F.sum(column) if self.kind == "sum" else F.max(column)


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], outs: list[Running]) -> DataFrame:
    """Add running columns per key. `bucket` must not decrease along `order` within a key.

    What a bucket starts from joins its rows as one more row in front, so the rows are shuffled
    once and NULL keys are keys like any other. `df` is read twice, so it should be cheap to read
    again (a checkpoint, a table or a cache).
    """
    values = {o.out: f"_v_{o.out}" for o in outs}
    rows = df.withColumns({"_bucket": bucket, **{values[o.out]: o.value for o in outs}})
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_bucket").agg(*[o.total(values[o.out]).alias(values[o.out]) for o in outs])
    heads = totals.select(
        *keys, "_bucket", F.lit(0).alias("_row"), *[o.over(values[o.out], before).alias(values[o.out]) for o in outs]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_row", *order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)

    def result(o: Running) -> Column:
        value = o.over(values[o.out], so_far if o.inclusive else earlier)
        return F.coalesce(value, F.lit(0)) if o.kind == "sum" else value

    both = rows.withColumn("_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    return both.select("*", *[result(o).alias(o.out) for o in outs]).where("_row = 1").select(
        *df.columns, *[o.out for o in outs]
    )


def number_rows(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Row number 1, 2, ... per key in `order`."""
    return running(df, keys, bucket, order, [Running(out, F.lit(1).cast("long"))])


def range_buckets(df: DataFrame, keys: list[str], order: list[str], out: str = "range_bucket") -> DataFrame:
    """Cut the rows into ranges of (keys, order) of about equal size, for any distribution.

    Equal rows are told apart by a row id, so a large group of copies is cut as well. Range bounds
    are sampled, so the result is checkpointed: a recomputed task must not move rows.
    """
    named = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = named.repartitionByRange(*[F.col(c) for c in [*keys, *order, "_tie"]])
    return cut(ranged.drop("_tie").withColumn(out, F.spark_partition_id()))
