"""Line-first cleaning: lines are judged first, then what is left of the document."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import table, words

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MIN_LEFT_PCT = 50
SYMBOLS = "#*$%&|<>"
# Line rules: a list of links has this many separators, and one to this many words; symbols may make
# up this share of a line; a line of this many words or more needs punctuation and different words.
NAV_SEPARATORS, NAV_WORDS_EACH = 3, 4
MAX_SYMBOL_PCT = 15
MIN_RULE_WORDS = 12
MIN_DISTINCT_PCT = 15
BOILERPLATE_CHARS = 300
# Up to this many different repeated windows are looked up one by one.
LOOK_UP = 24
# What marks a short line as boilerplate.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "click here", "cookie policy", "follow us", "licensed under",
    "lorem ipsum", "privacy policy", "read more", "share this", "sign up", "subscribe", "terms of use",
    "terms of service",
)


def _chars(w: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(w, ""))


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def line_fails(line: Column) -> Column:
    """Whether a line with a word is navigation, boilerplate, symbols or unpunctuated or repeating words."""
    def rules(w: Column) -> Column:
        n = F.size(w)
        nav = let(F.regexp_count(line, F.lit("[|>»•]")), lambda bars: (
            bars >= NAV_SEPARATORS) & (n <= bars * NAV_WORDS_EACH))
        symbols = _symbols(line) * 100 > _chars(w) * MAX_SYMBOL_PCT
        boiler = (F.length(line) <= BOILERPLATE_CHARS) & let(F.lower(line), lambda x: reduce(
            or_, [x.contains(b) for b in BOILERPLATE]))
        bare = (n >= MIN_RULE_WORDS) & ~line.rlike(r"[.,;:!?…。！？।؟]")
        same = (n >= MIN_RULE_WORDS) & (F.size(F.array_distinct(w)) * 100 < n * MIN_DISTINCT_PCT)
        return nav | symbols | boiler | bare | same

    return let(words(line), rules)


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    Windows are compared by a 64-bit hash inside their own text.
    """
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(
        F.array().cast("array<long>"))

    def hash_at(ordered: Column, k: Column) -> Column:
        return F.get(ordered, k)["h"]

    def places_by_sort(ordered: Column) -> Column:
        return F.transform(F.filter(ordered, lambda x, k: (x["h"] == hash_at(ordered, k - 1)).eqNullSafe(True)
                                    | (x["h"] == hash_at(ordered, k + 1)).eqNullSafe(True)), lambda x: x["i"])

    def places(h: Column, again: Column) -> Column:
        # A few different windows are looked up; many are found by sorting with their places.
        numbered = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        looked_up = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull())
        return F.when(F.size(again) <= LOOK_UP, looked_up).otherwise(let(F.array_sort(numbered), places_by_sort))

    def covered(h: Column, again: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(
            places(h, again), lambda i: F.array(i, i + 1, i + 2)))))

    def repeats(ordered: Column) -> Column:
        return F.array_distinct(F.filter(ordered, lambda x, k: x == F.get(ordered, k - 1)))

    return let(windows, lambda h: let(let(F.sort_array(h), repeats), lambda again: F.when(
        F.size(again) == 0, F.lit(0)).otherwise(covered(h, again))))


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts, cleaned text and verdict of each document, row by row.

    Lines that fail a rule are removed; a document is rejected if the rest holds
    less than MIN_LEFT_PCT of its characters in words, or by the base rules on
    the whole text. Null and empty texts have all counts 0 and are rejected.
    Repeated rows are judged alike; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", "_text", words(F.col("_text")).alias("_words"), F.filter(
        F.split("_text", "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("_lines"))
    rows = rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        _chars(F.col("_words")).cast("long").alias("word_chars"),
        _symbols(F.col("_text")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.array_join(F.filter("_lines", lambda x: ~line_fails(x)), "\n").alias("cleaned"))
    rows = rows.withColumn("left_chars", _chars(words(F.col("cleaned"))).cast("long"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    return rows.withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("left_chars") * 100 >= F.col("word_chars") * MIN_LEFT_PCT))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")
