"""Embedding rows as integer vectors: which rows take part, and their scaled integer components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")


def well_formed(vector: str = "embedding") -> Column:
    """True for a non-null vector with at least one entry, none of them null, NaN or infinite."""
    v = F.col(vector)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != F.lit(INFINITY)))
    return v.isNotNull() & (F.size(v) > 0) & finite


def scaled(scale: int, vector: str = "embedding") -> Column:
    """floor(scale * c) of each entry c taken as a double, as a long; exact, since scale is a power of two."""
    return F.transform(F.col(vector), lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long"))


def integer_vectors(embeddings: DataFrame, scale: int, *, one_length: bool = True) -> DataFrame:
    """(vec_id, label, x): rows with well-formed vectors, x = floor(scale * c) per entry.

    With `one_length`, the vectors must share one length to be compared: the most common length wins (ties:
    the longer) and rows of any other length are left out like malformed vectors. The given tables hold one
    length only. `label` is NULL where the table has none.
    """
    cols = embeddings.columns
    label = F.col("label").cast("long") if "label" in cols else F.lit(None).cast("long")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").alias("embedding"))
    rows = rows.where(well_formed()).select("vec_id", "label", scaled(scale).alias("x"))
    if not one_length:
        return rows
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return rows
    return rows.where(F.size("x") == lengths[0]["d"])
