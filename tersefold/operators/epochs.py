"""Which cache epoch each row falls into, from a table of control events.

A `compact` event makes every cache entry of its scope stale, a `resume` event
makes them usable again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage

# Up to this many control events the intervals between them are broadcast, and
# a row is compared with each interval of its scope.
BROADCAST_EVENTS = 256


def with_epoch(rows: DataFrame, control: DataFrame | None,
               broadcast_events: int = BROADCAST_EVENTS, ranges: int | None = None) -> DataFrame:
    """Add `epoch` (seq of the last compact event so far, -1 if none) and `stale`.

    stale: entries from before the epoch do not count, as no resume followed.
    Rows need scope and seq; seq is unique in a scope. `ranges` is the number
    of parts for many control events, by default that of a shuffle.
    """
    if control is None:
        return rows.withColumn("epoch", F.lit(-1).cast("long")).withColumn("stale", F.lit(False))
    control = control.select("scope", F.col("seq").cast("long").alias("seq"), "kind")
    few = control.limit(broadcast_events + 1).count() <= broadcast_events
    marked = _by_interval(rows, control) if few else _by_ranges(rows, control, ranges)
    compact, resume = F.col("_compact"), F.col("_resume")
    return marked.select(
        *rows.columns,
        F.coalesce(compact, F.lit(-1).cast("long")).alias("epoch"),
        F.coalesce((compact > resume) | (compact.isNotNull() & resume.isNull()), F.lit(False)).alias("stale"),
    )


def _last(kind: str):
    return F.max(F.when(F.col("kind") == kind, F.col("seq")))


def _by_interval(rows: DataFrame, control: DataFrame) -> DataFrame:
    order = W.partitionBy("scope").orderBy("seq")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = control.select(
        "scope", F.col("seq").alias("_from"), F.lead("seq").over(order).alias("_to"),
        _last("compact").over(upto).alias("_compact"), _last("resume").over(upto).alias("_resume"),
    ).withColumnRenamed("scope", "_scope")
    inside = (
        (F.col("scope") == F.col("_scope")) & (F.col("seq") > F.col("_from"))
        & (F.col("_to").isNull() | (F.col("seq") < F.col("_to")))
    )
    return rows.join(F.broadcast(spans), inside, "left")


def _by_ranges(rows: DataFrame, control: DataFrame, ranges: int | None) -> DataFrame:
    """For any number of events and any spread of seq: windows over ranges of (scope, seq), plus what
    earlier ranges ended with. The ranges are written, so they are drawn once."""
    both = rows.unionByName(control, allowMissingColumns=True)
    parts = both.repartitionByRange("scope", "seq") if ranges is None else both.repartitionByRange(ranges, "scope", "seq")
    both = stage(parts.withColumn("_range", F.spark_partition_id()), "rows")
    upto = W.partitionBy("scope", "_range").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    # One row per range and scope, which takes over from the ranges before it.
    before = W.partitionBy("scope").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = both.groupBy("scope", "_range").agg(_last("compact").alias("_c"), _last("resume").alias("_r")).select(
        "scope", "_range", F.max("_c").over(before).alias("_c"), F.max("_r").over(before).alias("_r"))
    marked = both.select(
        "*", _last("compact").over(upto).alias("_compact"), _last("resume").over(upto).alias("_resume"))
    return (
        marked.filter(F.col("kind").isNull()).join(carry, ["scope", "_range"], "left")
        .withColumn("_compact", F.coalesce("_compact", "_c"))
        .withColumn("_resume", F.coalesce("_resume", "_r"))
    )
