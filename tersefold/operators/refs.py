"""Known files, and notes in texts that mention them.

A path that was read before is marked where a text says "--> path" or
"at path:". Texts are not compared with the list of paths: the few places that
could name one are cut out and joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.commands import read_path
from ..session import stage
from .skew import DEFAULT_LIMITS, SkewLimits, join_unique

NOTE = " [in context]"
# Up to this many known paths are broadcast.
FEW_PATHS = 100_000


def known_paths(outputs: DataFrame) -> DataFrame:
    """Paths read by commands: scope, path and the first seq that read them."""
    return (
        outputs.select("scope", F.col("seq").alias("added_seq"), read_path(F.col("cmd")).alias("path"))
        .filter(F.col("path").isNotNull())
        .groupBy("scope", "path").agg(F.min("added_seq").alias("added_seq"))
    )


def merge_known(old: DataFrame, new: DataFrame) -> DataFrame:
    """First add wins."""
    return old.unionByName(new).groupBy("scope", "path").agg(F.min("added_seq").alias("added_seq"))


def mentions_path(text: Column) -> Column:
    return text.contains("--> ") | text.rlike(rf"at {fixed.NWS}+:")


def mention_words(text: Column) -> Column:
    """(word, colon) of every place that could name a path; colon: the path must end in front of one.

    Words that look like secrets are left out: these are written to tables.
    """
    arrow = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"--> (?=({fixed.NWS}++))"), F.lit(1)))
    at = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"at (?=({fixed.NWS}+:))"), F.lit(1)))
    pair = lambda colon: lambda w: F.struct(w.alias("word"), F.lit(colon).alias("colon"))
    return F.filter(F.concat(F.transform(arrow, pair(False)), F.transform(at, pair(True))),
                    lambda p: ~p["word"].rlike(fixed.SECRET))


def path_notes(texts: DataFrame, keys: Sequence[str], known: DataFrame,
               limits: SkewLimits = DEFAULT_LIMITS) -> DataFrame:
    """keys and `notes`: the known paths a text may name, by path, with the seq that read them.

    `texts` has keys, which include scope, and `words` of mention_words; it is
    unique by keys. A known path may be any leading part of a word. With few known
    paths the parts of all lengths that occur among them are looked up; with
    many, words and paths are sorted together, where a path stands in front of all it begins.
    """
    known = stage(known, "known")
    n_known = known.count()
    if n_known <= FEW_PATHS:
        found = _by_lengths(texts, keys, known)
    else:
        # The outer form, as the plain one would search every text once more to see if it has mentions.
        mentions = texts.select(*keys, F.explode_outer("words").alias("_word")).filter(F.col("_word").isNotNull())
        mentions = stage(mentions.select(*keys, "_word.word", "_word.colon"), "mentions")
        named = ["scope", "word", "colon"]
        paths = _by_order(mentions.select(*named).distinct(), known)
        paths = paths.groupBy(*named).agg(F.collect_list(F.struct("path", "added_seq")).alias("_paths"))
        found = join_unique(mentions, paths, named, keys[-1], mentions.count(), "inner", limits).select(
            *keys, F.explode("_paths").alias("_path")).select(*keys, "_path.*").distinct()
    return found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("path", "added_seq"))).alias("notes"))


def _by_lengths(texts: DataFrame, keys: Sequence[str], known: DataFrame) -> DataFrame:
    # Distinct lengths only: never more numbers than there are paths.
    lengths = sorted(r[0] for r in known.select(F.length("path")).distinct().collect())
    lengths = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")

    def parts(p: Column) -> Column:
        word = p["word"]
        fits = lambda n: F.when(p["colon"], F.substring(word, n + 1, F.lit(1)) == ":").otherwise(
            n <= F.length(word))
        return F.transform(F.filter(lengths, fits), lambda n: F.substring(word, F.lit(1), n))

    named = texts.select(*keys, F.explode_outer(F.array_distinct(F.flatten(F.transform("words", parts)))).alias("path"))
    return named.filter(F.col("path").isNotNull()).join(F.broadcast(known), ["scope", "path"])


def _by_order(words: DataFrame, known: DataFrame) -> DataFrame:
    """scope, word, colon, path and added_seq of every word and known path that it begins with.

    Both are sorted together in ranges. What begins a string stands in front of
    it, with nothing between that it does not begin, too; so one pass with the
    paths that the current string begins with finds all. The paths that begin
    the first string of a range are looked up for it: a few rows per range.
    """
    text = words.select("scope", F.col("word").alias("text"), "colon", F.lit(None).cast("long").alias("added_seq"))
    rows = text.unionByName(known.select("scope", F.col("path").alias("text"), F.lit(None).cast("boolean").alias("colon"), "added_seq"))
    ranged = stage(rows.repartitionByRange("scope", "text").withColumn("_range", F.spark_partition_id()), "ranges")
    first = ranged.groupBy("_range").agg(F.min(F.struct("scope", "text")).alias("_first"))
    parts = first.select("_range", "_first.scope", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("_first.text")), lambda n: F.substring("_first.text", F.lit(1), n))).alias("path"))
    open_ = parts.join(known, ["scope", "path"]).select(
        "scope", F.col("path").alias("text"), F.lit(None).cast("boolean").alias("colon"), "added_seq", "_range")
    order = ["_range", "scope", "text", F.col("colon").asc_nulls_first()]
    ordered = ranged.unionByName(open_).repartition("_range").sortWithinPartitions(*order).select(
        "_range", "scope", "text", "colon", "added_seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, begun = None, []
        for batch in batches:
            out: list[tuple] = []
            for range_, scope, text, colon, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != (range_, scope):
                    where, begun = (range_, scope), []
                while begun and not text.startswith(begun[-1][0]):
                    begun.pop()
                if colon is None:
                    if not begun or begun[-1][0] != text:
                        begun.append((text, seq))
                    continue
                out += [(scope, text, colon, path, added) for path, added in begun
                        if not colon or text.startswith(":", len(path))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)],
                ["scope", "word", "colon", "path", "added_seq"])

    return ordered.mapInArrow(run, "scope string, word string, colon boolean, path string, added_seq bigint")


def apply_notes(text: Column, notes: Column, seq: Column) -> Column:
    """Mark every path in `notes` that was read up to `seq`, in path order."""
    def mark(acc: Column, note: Column) -> Column:
        path = note["path"]
        acc = F.replace(acc, F.concat(F.lit("--> "), path), F.concat(F.lit("--> "), path, F.lit(NOTE)))
        return F.replace(acc, F.concat(F.lit("at "), path, F.lit(":")),
                         F.concat(F.lit("at "), path, F.lit(NOTE + ":")))

    usable = F.filter(notes, lambda note: note["added_seq"] <= seq)
    return F.when(notes.isNull(), text).otherwise(F.aggregate(usable, text, mark))


def annotate(outputs: DataFrame, known: DataFrame, text: str = "text",
             limits: SkewLimits = DEFAULT_LIMITS) -> DataFrame:
    """Outputs (scope, output_id, seq, text) with known paths marked as read."""
    keys = ["scope", "output_id"]
    words = outputs.filter(mentions_path(F.col(text))).select(*keys, mention_words(F.col(text)).alias("words"))
    notes = path_notes(words, keys, known, limits)
    return outputs.join(notes, keys, "left").select(
        *[c for c in outputs.columns if c != text],
        apply_notes(F.col(text), F.col("notes"), F.col("seq")).alias(text))
