"""Token counts through a digest cache.

Texts are normalised (runs of ASCII white space become one space, none at the ends: the tokenizer
drops white space, so no count changes), digested, and joined with stored counts on (content digest,
tokenizer-version digest). Only distinct texts without a stored count are encoded; their counts are
appended to the cache before the result is read from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import as_bytes, slices
from sitegraph.llm.word_tokens import version_of, word_tokens
from sitegraph.session import cut, hadoop_path

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The stored counts, one row per (content, tokenizer); none where the folder is missing or empty."""
    path, fs = hadoop_path(spark, cache_dir)
    if not fs.exists(path) or not any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(path)):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(path).encode
        for part in slices(batches):
            n = [len(encode(text)) // 4 for text in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["content", "n_tokens"])

    return count


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_dir: str) -> None:
    """Encode what the cache lacks, once per content, and append it.

    Equal texts meet in a partial aggregate on the map side, so a content that a third of the rows
    share sends one row per map task. The anti-join uses the partitioning of that aggregate. A task
    that runs again writes the same rows; the output committer keeps one attempt.
    """
    spark = docs.sparkSession
    version = version_of(tokenizer_path)
    stored = read_cache(spark, cache_dir).where(F.col("tokenizer") == version).select("content").distinct()
    distinct = (
        docs.select(content_digest(F.col("text")).alias("content"), normalised(F.col("text")).alias("text"))
        .groupBy("content")
        .agg(F.first("text").alias("text"))
    )
    misses = distinct.join(stored, "content", "left_anti").select("content", "text")
    counted = misses.mapInArrow(_counter(tokenizer_path), "content binary, n_tokens long")
    rows = counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens")
    rows.write.mode("append").parquet(cache_dir)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_dir: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every text.

    Rows are kept as they are: repeated rows and NULL or repeated ids give a row each. A NULL text
    counts as empty (0 bytes, 0 tokens). Other columns of `docs` are not read. An empty table gives
    an empty result. Two writers may append the same content; the cache is read distinct.
    """
    fill_cache(docs, tokenizer_path, cache_dir)
    version = version_of(tokenizer_path)
    stored = read_cache(docs.sparkSession, cache_dir).where(F.col("tokenizer") == version)
    # cut, so that both sides of the join are shuffled for it and a hot content can be split
    counts = cut(stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    rows = docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        content_digest(F.col("text")).alias("content"),
    )
    return rows.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
