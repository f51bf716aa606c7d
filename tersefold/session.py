"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_collecting: ContextVar[tuple[list[str], ...]] = ContextVar("collecting", default=())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from spark.checkpoint.dir.

    Only a local session may do without the setting; it gets a fresh folder,
    kept in the session settings so that later calls share it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tersefold.local.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="tersefold-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("tersefold.local.dir", path)
    return path


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# Tables of texts are written so, also those that a query keeps until its end.
TEXT_CODEC = "zstd"


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back. codec: of the files, if not the session's.

    Cuts the lineage, survives lost executors, and lets later readers take
    single columns. The folder stays until whoever collects it (`collected`)
    removes it, or else to the retention of the checkpoint dir.
    """
    path = new_dir(df.sparkSession, label)
    for paths in _collecting.get():
        paths.append(path)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_buckets(spark: SparkSession) -> int:
    """Buckets of a table, no fewer than a shuffle has parts, so that joins take the bucketing over."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def stage_buckets(parts: Sequence[DataFrame], keys: Sequence[str], label: str) -> DataFrame:
    """Write tables of the same columns as one, bucketed by keys: whoever groups by these reads it without a shuffle.

    Parts that come from such a table, and keep their rows where they are, are
    not shuffled either. Only the files stay, like those of `stage`.
    """
    spark = parts[0].sparkSession
    path = new_dir(spark, label)
    for paths in _collecting.get():
        paths.append(path)
    name = f"{label}_{uuid.uuid4().hex}"
    for part in parts:
        (part.select(*parts[0].columns).write.format("parquet").mode("append").option("path", path)
         .option("compression", TEXT_CODEC).bucketBy(n_buckets(spark), *keys).saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of queries that are done, which it does when the driver's objects for them are collected."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders of all tables that are staged inside the block."""
    paths: list[str] = []
    token = _collecting.set((*_collecting.get(), paths))
    try:
        yield paths
    finally:
        _collecting.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, wherever Spark can reach them; those that are gone already are passed over."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)
