"""JSONL crawl logs: partitioned writer and a tolerant reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.functions.paths import log_dirs, slug
from sitegraph.schemas import LOG_LINE
from sitegraph.session import hadoop_path

ARCHIVE = "_posted"
# Levels of `<dir>/<dir>/<file>`, the layout of nodes and of our own writer.
LAYOUT_DEPTH = 3
SUFFIXES = "jsonl,json"


def log_path(log: DataFrame) -> DataFrame:
    """Add client_dir, lead_dir and file of the log a record belongs to."""
    client_dir, lead_dir = log_dirs(F.col("client_id"), F.col("lead_id"), F.col("website_id"), F.col("user_id"))
    return log.withColumns(
        {
            "client_dir": client_dir,
            "lead_dir": lead_dir,
            "file": F.concat(slug(F.col("task_id")), F.lit(".jsonl")),
        }
    )


def log_file_order(log: DataFrame) -> DataFrame:
    """Log files in the order they are processed."""
    files = log_path(log).groupBy("client_dir", "lead_dir", "file").agg(F.count(F.lit(1)).alias("records"))
    return files.select(F.concat_ws("/", "client_dir", "lead_dir", "file").alias("path"), "records").orderBy("path")


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Write log lines as JSON under client_dir/lead_dir.

    The rebalance hint lets AQE merge small directories' rows into few tasks and split the rows of
    a directory that holds most of them.
    """
    filed = log_path(log).drop("file").hint("rebalance", "client_dir", "lead_dir")
    filed.write.mode(mode).partitionBy("client_dir", "lead_dir").json(path)


def _parse(lines: DataFrame, archive: str) -> DataFrame:
    """Text lines to log columns.

    Any JSON object is a record; a field of another type than expected is NULL and does not make
    its line corrupt, which is why the lines are parsed as variants and not with the schema.
    """
    archived = F.col("_metadata.file_path").contains(f"/{archive}/")
    parsed = lines.where(~archived & F.col("value").rlike(r"^\s*\{")).select(F.try_parse_json("value").alias("v"))
    return parsed.where(F.col("v").isNotNull()).select(
        *[F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in LOG_LINE.fields]
    )


def depth_of(spark: SparkSession, path: str) -> int:
    """Levels of files and folders below `path`, from the file system's own listing."""
    root, fs = hadoop_path(spark, path)
    depth = 0
    while True:
        level, _ = hadoop_path(spark, f"{root}{'/*' * (depth + 1)}")
        if not fs.globStatus(level):
            return depth
        depth += 1


def _files(path: str, suffixes: str, depth: int) -> str:
    # Explicit globs, because a recursive listing hides directories such as `_unfiled`.
    levels = ",".join("/".join("*" * n) for n in range(1, max(1, depth) + 1))
    return f"{path.rstrip('/')}/{{{levels}}}.{{{suffixes}}}"


def read_log(spark: SparkSession, path: str, suffixes: str = SUFFIXES, archive: str = ARCHIVE) -> DataFrame:
    """All valid lines below `path`, at any depth; blank and corrupt lines and the archive are skipped."""
    return _parse(spark.read.text(_files(path, suffixes, depth_of(spark, path))), archive)


def stream_log(
    spark: SparkSession,
    path: str,
    files_per_trigger: int = 1000,
    suffixes: str = SUFFIXES,
    archive: str = ARCHIVE,
    depth: int = LAYOUT_DEPTH,
) -> DataFrame:
    """The same lines as a stream over files as they land, down to `depth` levels.

    A stream's pattern is fixed when it starts; if something lies deeper by then, it is refused.
    """
    found = depth_of(spark, path)
    if found > depth:
        raise ValueError(f"{path} has files {found} levels deep; ask for depth={found}")
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(_files(path, suffixes, depth))
    return _parse(lines, archive)
