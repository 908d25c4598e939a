"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.session import fresh_path, hadoop_path

#: Rows taken out of an Arrow batch at a time, so that long texts are not all held as Python objects.
SLICE_ROWS = 256
#: Bytes that one remembered table of a Python worker (chunks and their ids or scores, word hashes) may
#: take; it is emptied when it would grow beyond. Two or three such tables live in a worker at once.
TABLE_BYTES = 32 << 20
#: Bytes a dict entry costs besides its key and value (hash slot, key and value objects).
ENTRY_BYTES = 120


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns (of any name) never meet those an operator adds."""
    return df.select(*columns)


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def hash_bound(rows: int, wanted: int) -> int:
    """A bound on 64-bit hashes below which about twice the wanted rows lie.

    Rows above it are left out before the wanted ones are picked in order, so that what one task or the
    driver sorts does not grow with the table or its partitions.
    """
    share = min(1.0, (2 * wanted + 100) / max(1, rows))
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def give_back() -> None:
    """Return what earlier tasks and batches have freed to the system: workers are used again, and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, NULL as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return ["" if v is None else v for v in column.to_pylist()]


class Scratch:
    """Tables in the shared folder that cut lineage, removed when the block ends.

    Used in place of checkpoints where later steps read few of the columns, and in loops: a table read
    back carries no constraints, whose number would double with each round. What leaves the block must
    not read from these tables any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, "scratch")
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            folder, fs = hadoop_path(self.spark, path)
            fs.delete(folder, True)
