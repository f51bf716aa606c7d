"""Sources and sinks of the tables the jobs work on."""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import merge_cache
from ..operators.folds_lines import number_lines
from ..operators.refs import merge_known

LOG_SCHEMA = "ts timestamp, scope string, cmd string, original_tokens long, compressed_tokens long, day date"


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """One output per file: path and text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def stream_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Files arriving in a folder, one output each: path, ts of the file, and text."""
    return spark.readStream.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("ts"), F.col("value").alias("text"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line table of large LF text logs: path, pos and line, of files that Spark may split.

    A last line that was not closed is closed.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        # Rises along each block, and only its order is used.
        F.monotonically_increasing_id().alias("row"),
        F.concat("value", F.lit("\n")).alias("line"))
    return number_lines(lines).select("path", "pos", "line")


_COMMIT = "batch string, attempt string, first timestamp, last timestamp"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """What the log at `path` consists of: one row per batch; empty before the first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).parquet(f"{path}/commits/*")


def append_log(log: DataFrame, path: str, batch: str | int | None = None) -> bool:
    """Append to the compaction log, one folder per day so that look-backs read few of them.

    A batch is in the log once, however often it is appended: rows are written to a
    folder of this attempt, and count only with the commit, one file per batch, that names it. Returns
    whether the batch was new; without a batch id every call is one.
    """
    spark, attempt = log.sparkSession, uuid.uuid4().hex
    batch = attempt if batch is None else str(batch)
    if not _commits(spark, path).filter(F.col("batch") == batch).isEmpty():
        return False
    folder = f"{path}/data/attempt={attempt}"
    # The rows of a day meet in one task, or a few if they are many; else every task had a file for every day.
    log.withColumn("day", F.to_date("ts")).hint("rebalance", "day").write.partitionBy("day").parquet(folder)
    first, last = spark.read.schema(log.schema).parquet(folder).agg(F.min("ts"), F.max("ts")).first()
    name = hashlib.sha256(batch.encode()).hexdigest()[:32]
    spark.createDataFrame([(batch, attempt, first, last)], _COMMIT).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/commits/{name}")
    return True


def read_log(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """The compaction log, optionally from a point in time on; attempts that did not commit are not seen."""
    commits = _commits(spark, path)
    if since is not None:
        # The driver's list has a row per batch; a batch without any time in reach is not opened.
        commits = commits.filter(F.col("last") >= F.lit(since))
    attempts = sorted(r.attempt for r in commits.collect())
    if not attempts:
        return spark.createDataFrame([], LOG_SCHEMA)
    log = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/attempt={a}" for a in attempts]).drop("attempt")
    if since is not None:
        since = F.lit(since)
        log = log.filter((F.col("day") >= F.to_date(since)) & (F.col("ts") >= since))
    return log


def write_cache(old: DataFrame | None, new: DataFrame, path: str) -> None:
    """New snapshot of the cache; the old one is left as it is."""
    merge_cache(old, new).write.parquet(path)


def write_known(old: DataFrame, new: DataFrame, path: str) -> None:
    """New snapshot of the known paths; the old one is left as it is."""
    merge_known(old, new).write.parquet(path)
