"""Savings over a compaction log: scope, ts, cmd, original_tokens, compressed_tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import reduction_pct


HOUR = 3600


def savings(by: Sequence[str] = ()) -> list[Column]:
    return _savings(F.count(F.lit(1)), F.sum("original_tokens"), F.sum("compressed_tokens"))


def _savings(compressions: Column, original: Column, compressed: Column) -> list[Column]:
    original = F.coalesce(original, F.lit(0).cast("long"))
    compressed = F.coalesce(compressed, F.lit(0).cast("long"))
    return [
        F.coalesce(compressions, F.lit(0).cast("long")).alias("compressions"),
        original.alias("original_tokens"),
        compressed.alias("compressed_tokens"),
        (original - compressed).alias("tokens_saved"),
        reduction_pct(original, compressed, 1).alias("reduction_pct"),
    ]


def lookback_stats(log: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row of totals for the last hours; zeros if there is nothing."""
    return log.filter(F.col("ts") >= now - F.expr(f"INTERVAL {int(hours)} HOURS")).agg(*savings())


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("compressions", "original_tokens", "compressed_tokens")])


def hourly_sums(log: DataFrame) -> DataFrame:
    """Sums of each hour: hour (since 1970), compressions, original_tokens, compressed_tokens.

    Sums of parts of a log are merged by merge_sums; rows without a time are in none.
    """
    hours = log.filter(F.col("ts").isNotNull()).select(
        F.expr(f"unix_seconds(ts) div {HOUR}").alias("hour"), F.lit(1).cast("long").alias("compressions"),
        F.col("original_tokens").cast("long").alias("original_tokens"),
        F.col("compressed_tokens").cast("long").alias("compressed_tokens"))
    return _sums(hours, "hour")


def merge_sums(one: DataFrame, other: DataFrame) -> DataFrame:
    return _sums(one.unionByName(other), "hour")


def window_savings(windows: DataFrame, log: DataFrame, sums: DataFrame) -> DataFrame:
    """Savings of any number of windows (window_id, start, end; from start on and before end), from hourly sums.

    Whole hours between the edges come from running totals, one row for each hour
    between the first and the last of the log; the log is read only in the hours
    the edges are in, and its rows of one second are added up before they
    meet the windows. A window without entries has zeros.
    """
    numbers = ["compressions", "original_tokens", "compressed_tokens"]
    first, last = sums.agg(F.min("hour"), F.max("hour")).first()
    first, last = first or 0, -1 if last is None else last
    windows = windows.select("window_id", F.unix_seconds("start").alias("_from"), F.unix_seconds("end").alias("_to"))
    windows = windows.withColumns({"_h0": F.expr(f"floor(_from / {HOUR})"), "_h1": F.expr(f"floor(_to / {HOUR})")})
    # Totals of all hours before each hour; hours without entries are there, too.
    hours = windows.sparkSession.range(first, last + 2).select(F.col("id").alias("hour")).join(sums, "hour", "left")
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    totals = hours.select("hour", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in numbers])

    def clamped(hour: Column) -> Column:
        return F.greatest(F.lit(first), F.least(F.lit(last + 1), hour)).cast("long")

    ends = [totals.select(F.col("hour").alias(f"_at{k}"), *[F.col(c).alias(f"_{c}{k}") for c in numbers]) for k in (0, 1)]
    inner = windows.select("window_id", clamped(F.col("_h0") + 1).alias("_at0"),
                           clamped(F.greatest(F.col("_h0") + 1, F.col("_h1"))).alias("_at1"))
    inner = inner.join(ends[0], "_at0").join(ends[1], "_at1").select(
        "window_id", *[(F.col(f"_{c}1") - F.col(f"_{c}0")).alias(c) for c in numbers])
    seconds = _sums(log.select(F.unix_seconds("ts").alias("_s"), F.lit(1).cast("long").alias("compressions"),
                               *numbers[1:]).withColumn("hour", F.expr(f"floor(_s / {HOUR})")), "hour", "_s")
    edges = windows.select("window_id", "_from", "_to", F.explode(F.array_distinct(F.array("_h0", "_h1"))).alias("hour"))
    edges = edges.join(seconds, "hour").filter("_s >= _from AND _s < _to").select("window_id", *numbers)
    both = _sums(inner.unionByName(edges), "window_id")
    return both.select("window_id", *_savings(*[F.col(c) for c in numbers]))


def stats_by(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys).agg(*savings())


def row_reduction(log: DataFrame) -> DataFrame:
    """Whole percent saved by each compaction; null where nothing was saved."""
    o, c = F.col("original_tokens"), F.col("compressed_tokens")
    return log.withColumn("reduction_pct", F.when(o > c, reduction_pct(o, c, 0)))
