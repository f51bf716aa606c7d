"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy from this many rows on, or from a 1/HEAVY_KEYS_MAX share of
# all rows if that is more. So there are at most HEAVY_KEYS_MAX heavy keys, and
# the splits of all of them together are at most twice as many.
HEAVY_ROWS = 1_000_000
# Where each row of a key gets a text, its characters count instead of rows.
HEAVY_CHARS = 256_000_000
HEAVY_KEYS_MAX = 2_000


@dataclass(frozen=True)
class SkewLimits:
    heavy_rows: int = HEAVY_ROWS
    heavy_keys_max: int = HEAVY_KEYS_MAX
    heavy_chars: int = HEAVY_CHARS

    def threshold(self, total: int, by_chars: bool = False) -> int:
        return max(self.heavy_chars if by_chars else self.heavy_rows, -(-total // self.heavy_keys_max))


DEFAULT_LIMITS = SkewLimits()


def heavy_keys(rows: DataFrame, keys: Sequence[str], total: int,
               limits: SkewLimits = DEFAULT_LIMITS, chars: str | None = None) -> DataFrame | None:
    """Keys with too many rows for one task and how many parts to split each into.

    With `chars`, a column of lengths, a key weighs as many characters as its
    rows have together, and `total` is their sum. None if the table is too small
    to have any. The count is combined on the map side, so it has no hot task
    itself.
    """
    threshold = limits.threshold(total, chars is not None)
    if total < threshold:
        return None
    weight = F.count(F.lit(1)) if chars is None else F.sum(chars)
    return (
        rows.groupBy(*keys).agg(weight.alias("_n"))
        .filter(F.col("_n") >= threshold)
        .select(*keys, F.ceil(F.col("_n") / threshold).cast("int").alias("_parts"))
    )


def join_unique(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread_by: str,
                total: int, how: str = "left", limits: SkewLimits = DEFAULT_LIMITS,
                counted: DataFrame | None = None, chars: str | None = None) -> DataFrame:
    """Join rows to a lookup table that is unique by `keys`.

    Rows of a heavy key are spread over several parts by the hash of
    `spread_by`, and the one lookup row of that key is copied to each part.
    The list of heavy keys is bounded (see above), so it may be broadcast.
    Keys must not be null. The keys are counted on `counted`, or on `rows`,
    which is then read twice and should be a written table; `chars` as in heavy_keys.
    """
    heavy = heavy_keys(rows if counted is None else counted, keys, total, limits, chars)
    if heavy is None:
        return rows.join(lookup, list(keys), how)
    heavy = F.broadcast(heavy)
    parted_rows = (
        rows.join(heavy, list(keys), "left")
        .withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(spread_by), F.col("_parts")))
                    .otherwise(F.lit(0)).cast("int"))
        .drop("_parts")
    )
    parted_lookup = (
        lookup.join(heavy, list(keys), "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_parts")
    )
    return parted_rows.join(parted_lookup, [*keys, "_part"], how).drop("_part")
