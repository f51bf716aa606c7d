"""Mixing sources to target weights by hash-random order and exact cuts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import n_words, prefix_sums, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
ORDER = ["_key", "doc_id", "size"]


@dataclass(frozen=True)
class Mix:
    """`rows`: one row per document, with size, source_size, target, taken and copies.
    `sources`: one row per source, with target, whole epochs and the last row of the part epoch."""

    rows: DataFrame
    sources: DataFrame


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def _random_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target of every source (source, source_size); all targets add up to all sizes.

    Sources in code point order, null last, take the weights in turn. Shares
    above max_epochs times the source's size stop there, and the rest is shared
    again by weight. Each round is one sum over the sources; only that sum
    comes to the driver. Sources without words have the target 0.
    """
    ranked = prefix_sums(
        sizes.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], "source_size")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_index") % len(weights)).cast("int"))
    ranked = stage(ranked.select(
        F.col("_index").alias("_g"), "source", "source_size", weight.cast("long").alias("weight"),
        (F.col("source_size") * max_epochs).alias("most")), "sources")
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weights = total or 0, all_weights or 1
    capped, capped_weights = 0, 0
    while True:
        share, among = total - capped, all_weights - capped_weights
        above = F.col("most").cast("double") * among < F.col("weight").cast("double") * share
        got, got_weights = ranked.filter(above).agg(F.sum("most"), F.sum("weight")).first()
        if (got_weights or 0) == capped_weights:
            break
        capped, capped_weights = got, got_weights
    target = F.when(above, F.col("most").cast("double")).otherwise(
        (F.col("weight") * share).cast("double") / F.lit(float(among or 1)))
    return ranked.withColumn("target", target)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        size: Column | None = None) -> Mix:
    """What each document gives to the mix.

    A source is read in the order of a hash of the ids, again and again, until
    its budget (the target, rounded) is used: whole epochs first, then the rows
    ahead of the cut, of which the last may give only a part of its words. Only
    ids, sizes and sources are shuffled; a source is spread over many tasks.
    Null text has size 0 and is in as many copies as its place says. Rows equal
    in id and size are single rows. Empty table: no rows.
    """
    size = n_words(F.col("text")) if size is None else size
    rows = stage(docs.select("doc_id", "source", size.alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, max_epochs)
    budget = F.round("target").cast("long")
    whole = F.coalesce(F.expr("_budget div nullif(source_size, 0)"), F.lit(0))
    sources = stage(sources.withColumn("_budget", budget).select(
        "_g", _source_key(F.col("source")).alias("_source"), "source_size", "target",
        whole.alias("epochs"), (F.col("_budget") - whole * F.col("source_size")).alias("rest")), "budgets")
    keyed = rows.withColumn("_source", _source_key(F.col("source"))).drop("source").join(
        sources.select("_source", "_g"), "_source").select(
        "_g", _random_key(F.col("doc_id"), seed).alias("_key"), "doc_id", "size")
    placed = prefix_sums(keyed, ["_g"], ORDER, "size").join(sources, "_g")
    inside = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("_before")))
    ahead = F.col("_before") < F.col("rest")
    placed = placed.select(
        "_g", *ORDER, "source_size", "target",
        (F.col("epochs") * F.col("size") + inside).alias("taken"),
        (F.col("epochs") + ahead.cast("long")).alias("copies"), ahead.alias("_ahead"))
    last = placed.filter("_ahead").groupBy("_g").agg(F.max(F.struct(*ORDER)).alias("last"))
    return Mix(placed.drop("_g", "_key", "_ahead"),
               sources.join(last, "_g", "left").select("_source", "target", "epochs", "last"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
                    seed: str = SEED) -> DataFrame:
    """The mix as rows: each document as often as it is taken, columns unchanged.

    Documents stay whole, so a source goes over its budget by a part of one
    document at most. The sources' last rows decide; where their table is small
    the texts are not shuffled.
    """
    size = n_words(F.col("text"))
    sources = stage(mix(docs, weights, max_epochs, seed).sources, "cuts")
    own = F.struct(_random_key(F.col("doc_id"), seed).alias("_key"), F.col("doc_id"), size.alias("size"))
    plan = sources.select("_source", F.struct("epochs", "last").alias("_plan"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), own.alias("_own"),
                         _source_key(F.col("source")).alias("_source"))
    part = F.coalesce(F.col("_own") <= F.col("_plan.last"), F.lit(False)).cast("long")
    copies = F.array_repeat(F.lit(1), (F.col("_plan.epochs") + part).cast("int"))
    return packed.join(plan, "_source").select("_row", F.explode(copies)).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).rows.select("doc_id", "size", "source_size", "target", "taken")
