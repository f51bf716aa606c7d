"""As-of duplicate detection, the cache of compacted texts, and its references.

A row is a reference when an equal text was stored before it and still counts.
Text is stored only if it shrinks and holds no secret, which depends on the
text and the command family alone; so the first storable position of every
text, overall and in each epoch, decides all its rows. That is a plain minimum
per text, combined on the map side, and no window over the copies of a text is
needed, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import DEFAULT_LIMITS, SkewLimits, join_unique

ANY_EPOCH = -1
# Characters of a reference token.
REF_LENGTH = 22


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def short_ref(fp: Column) -> Column:
    return F.substring(fp, 1, 16)


def ref_token(fp: Column) -> Column:
    return F.concat(F.lit("§ref:"), short_ref(fp), F.lit("§"))


def token_ref(text: Column) -> Column:
    """The 16 hex digits of a text that is just a reference token, or null."""
    return F.nullif(F.regexp_extract(text, r"\A§ref:([0-9a-f]{16})§\z", 1), F.lit(""))


def stored_rows(rows: DataFrame, storable: DataFrame, total: int, limits: SkewLimits = DEFAULT_LIMITS) -> DataFrame:
    """First storable seq per (scope, fp, epoch): what these rows add to the cache.

    rows: scope, seq, fp, family, epoch; storable: (fp, family) of texts that are stored.
    """
    first = rows.groupBy("scope", "fp", "family", "epoch").agg(F.min("seq").alias("seq"))
    first = join_unique(first, storable, ["fp", "family"], "seq", total, "left_semi", limits, counted=rows)
    return first.groupBy("scope", "fp", "epoch").agg(F.min("seq").alias("seq"))


def first_stored(own: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """First storable seq per (scope, fp, epoch_key): one row per epoch and one for ANY_EPOCH.

    own: stored_rows; cached: scope, fp, seq, epoch of entries stored by earlier runs.
    """
    first = own.select("scope", "fp", "epoch", "seq")
    if cached is not None:
        first = first.unionByName(cached.select("scope", "fp", "epoch", "seq"))
    keys = F.array_distinct(F.array(F.col("epoch"), F.lit(ANY_EPOCH).cast("long")))
    return (
        first.withColumn("epoch_key", F.explode(keys))
        .groupBy("scope", "fp", "epoch_key").agg(F.min("seq").alias("stored_seq"))
    )


def outdated(full: DataFrame, stored: DataFrame) -> DataFrame:
    """Of rows that got their whole text (scope, fp, epoch, stale, seq, ...), those that are references by now.

    stored: scope, fp, epoch and seq of entries that came later but stand before them. Both may repeat keys.
    """
    keyed = full.withColumn("epoch_key", F.when(F.col("stale"), F.col("epoch")).otherwise(F.lit(ANY_EPOCH).cast("long")))
    return keyed.join(first_stored(stored), ["scope", "fp", "epoch_key"]).filter("stored_seq < seq").select(*full.columns)


def mark_refs(rows: DataFrame, stored: DataFrame, total: int,
              limits: SkewLimits = DEFAULT_LIMITS) -> DataFrame:
    """Add is_ref to rows (scope, seq, fp, epoch, stale, ...)."""
    keyed = rows.withColumn(
        "epoch_key", F.when(F.col("stale"), F.col("epoch")).otherwise(F.lit(ANY_EPOCH).cast("long")))
    out = join_unique(keyed, stored, ["scope", "fp", "epoch_key"], "seq", total, "left", limits)
    return out.select(
        *rows.columns,
        F.coalesce(F.col("stored_seq") < F.col("seq"), F.lit(False)).alias("is_ref"))


def merge_cache(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Cache after adding entries: the last write of each (scope, fp) wins.

    Entries: scope, fp, ref, compressed, original_tokens, compressed_tokens,
    last_storable_seq, created_at. The order of writes is (created_at, last_storable_seq).
    """
    both = new if old is None else old.unionByName(new)
    value = F.struct("ref", "compressed", "original_tokens", "compressed_tokens",
                     "last_storable_seq", "created_at")
    return (
        both.groupBy("scope", "fp")
        .agg(F.max_by(value, F.struct("created_at", "last_storable_seq")).alias("v"))
        .select("scope", "fp", "v.*")
    )


def resolve_refs(rows: DataFrame, cache: DataFrame, text: str = "result", spread_by: str = "seq",
                 total: int | None = None, limits: SkewLimits = DEFAULT_LIMITS) -> DataFrame:
    """Add `content`: the cached text where `text` is a reference token, else the text.

    Also adds `ref_matches`, the number of cached texts with that short
    reference; with more than one the content is null instead of a guess.
    """
    entries = cache.groupBy("scope", "ref").agg(
        F.any_value("compressed").alias("_content"), F.count(F.lit(1)).alias("ref_matches"))
    keyed = rows.withColumn("ref", token_ref(F.col(text)))
    plain = keyed.filter(F.col("ref").isNull()).select(
        *rows.columns, F.col(text).alias("content"), F.lit(0).cast("long").alias("ref_matches"))
    refs = keyed.filter(F.col("ref").isNotNull())
    refs = join_unique(refs, entries, ["scope", "ref"], spread_by,
                       rows.count() if total is None else total, "left", limits)
    found = F.coalesce("ref_matches", F.lit(0).cast("long"))
    return plain.unionByName(refs.select(
        *rows.columns, F.when(found == 1, F.col("_content")).alias("content"),
        found.alias("ref_matches")))
