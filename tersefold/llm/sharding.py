"""Contiguous shards of nearly equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_sums, table

N_SHARDS = 8


def _rows(docs: DataFrame, key: str, text: str) -> list[Column]:
    content = F.coalesce(F.col(text), F.lit(""))
    return [F.col(key).alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"),
            F.crc32(content).alias("text_crc32")]


ORDER = ["doc_id", "size", "text_crc32"]


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row.

    Rows are laid in the order of id, size and crc32 (null ids first); size is
    the UTF-8 bytes of the text plus 1. A row belongs to the shard in whose
    equal part of all bytes it begins, so shards are contiguous and differ from
    their target by one row at most; one text longer than a part leaves shards
    empty. Null text: size 1. Equal rows are single rows that may be split
    between shards. Empty table: no rows. Other columns are not read.
    """
    placed = prefix_sums(docs.select(*_rows(docs, key, text)), [], ORDER, "size")
    total = docs.select(_rows(docs, key, text)[1]).agg(F.sum("size")).first()[0] or 1
    placed = placed.withColumn("shard", F.expr(f"cast(_before * {n_shards} div {total} as int)"))
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    # One row per shard, whose number is a parameter.
    return placed.join(F.broadcast(first), "shard").select(
        *ORDER, "shard", (F.col("_index") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns with their `shard`; texts are not shuffled.

    The shards of `assign_shards` are known by their first row each: a row's
    shard is that of the last first row not above it. Rows equal in id, size
    and crc32 go to one shard here. A column named `shard` is replaced.
    """
    assigned = assign_shards(docs, n_shards, key, text)
    firsts = assigned.groupBy("shard").agg(F.min(F.struct(*ORDER)).alias("at")).collect()  # n_shards rows
    own = F.struct(*_rows(docs, key, text))
    kind = assigned.select(F.struct(*ORDER).alias("at")).schema["at"].dataType
    shard = F.lit(None).cast("int")
    for row in sorted(firsts, key=lambda r: r["shard"]):
        shard = F.when(_at_least(own, row["at"], kind), F.lit(row["shard"])).otherwise(shard)
    return docs.withColumn("shard", shard)


def _at_least(own: Column, at, kind) -> Column:
    bound = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(at, kind.fields, strict=True)])
    return own >= bound


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
