"""The whole compaction of a table of outputs.

outputs: output_id, ts, seq, scope, cmd, text. output_id is unique and not null; seq
is the order of the rows and unique in a scope; scope is not null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.commands import base_command, family
from ..functions.text import (
    collapse_blank_lines, is_blank, other_line_ends, strip_ansi, token_estimate, with_secret,
)
from ..operators import folds_doc
from ..operators.dedup import REF_LENGTH, fingerprint, first_stored, mark_refs, ref_token, short_ref, stored_rows
from ..operators.epochs import with_epoch
from ..operators.refs import apply_notes, mention_words, mentions_path, path_notes
from ..operators.skew import DEFAULT_LIMITS, SkewLimits, join_unique
from ..session import TEXT_CODEC, collected, remove, stage

# Ids and fingerprints of so many texts, of about 100 bytes each, are sent to all tasks.
BROADCAST_TEXTS = 300_000
COMPACTED = ["output_id", "ts", "seq", "scope", "cmd", "base_cmd", "family", "is_secret", "fp",
             "result", "outcome", "orig_tokens", "comp_tokens"]


def prepare(outputs: DataFrame) -> DataFrame:
    """Add blank, raw_len, base_cmd, family and stripped: the text cut to size, without escapes."""
    df = outputs.withColumns({
        "blank": F.coalesce(is_blank(F.col("text")), F.lit(True)), "raw_len": F.coalesce(F.length("text"), F.lit(0)),
        "base_cmd": base_command(F.coalesce("cmd", F.lit("")))})
    df = folds_doc.cut_bytes(df, "text", "_cut")
    return df.withColumns({
        "family": family(F.col("base_cmd")), "stripped": strip_ansi(F.col("_cut"))}).drop("_cut")


def fold(df: DataFrame, text: str, out: str) -> DataFrame:
    """All folding of one text in order: its family's rule, blank lines, repeats, length."""
    for _, step in fold_steps(text, out):
        df = step(df)
    return df.drop("_mixed")


def fold_steps(text: str, out: str) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The steps of `fold` by name. `_mixed` marks texts with line ends besides LF on the way;
    only decoded JSON can gain some."""
    other = F.col("family") == fixed.OTHER_FAMILY

    def json(df: DataFrame) -> DataFrame:
        df = folds_doc.minify_json(df, out, out, other)
        return df.withColumn("_mixed", F.when(other, other_line_ends(out)).otherwise(F.col("_mixed")))

    return [
        ("family_rule", lambda df: folds_doc.fold_family(
            df.withColumn("_mixed", other_line_ends(text)), text, "family", out, "_mixed")),
        ("json", json),
        ("blank_lines", lambda df: df.withColumn(out, collapse_blank_lines(F.col(out)))),
        ("repeats", lambda df: folds_doc.collapse_repeats(df, out, out, "_mixed")),
        ("line_cut", lambda df: folds_doc.cut_lines(df, out, out, "_mixed")),
    ]


def fold_guarded(df: DataFrame) -> DataFrame:
    """Add shrinks, is_secret and body: the folded text if that is shorter, else stripped."""
    df = fold(df, "stripped", "_folded")
    df = with_secret(df, "stripped").withColumn("shrinks", F.expr("length(_folded) < length(stripped)"))
    return df.withColumn("body", F.expr("if(shrinks, _folded, stripped)")).drop("_folded")


def compact_text(outputs: DataFrame) -> DataFrame:
    """Compaction of every row by itself, without cache or notes; also for streams."""
    df = fold_guarded(prepare(outputs))
    outcome = F.when(F.col("blank"), "empty").when(F.col("shrinks"), "compressed").otherwise("unchanged")
    df = df.withColumn("result", F.when(F.col("blank"), F.col("text")).otherwise(F.col("body")))
    return df.select(
        *[c for c in outputs.columns if c != "text"], "base_cmd", "family",
        (F.col("is_secret") & ~F.col("blank")).alias("is_secret"), "result", outcome.alias("outcome"),
        token_estimate(F.col("raw_len")).alias("orig_tokens"),
        token_estimate(F.coalesce(F.length("result"), F.lit(0))).alias("comp_tokens"))


@dataclass(frozen=True)
class Compaction:
    """compacted: one row per output; cache_entries: what a cache gains, to be merged into it; log: tokens of each output.

    All read tables that were staged for them; `close` removes those, when
    what was wanted has been written. A text with a secret is in none of them.
    The log is made from lengths and reads texts only where notes were added.
    stored and full are keys: the first stored position of each text and epoch, and the rows that got their whole text.
    """

    compacted: DataFrame
    cache_entries: DataFrame
    log: DataFrame
    stored: DataFrame
    full: DataFrame
    staged: list[str] = field(default_factory=list)

    def close(self) -> None:
        remove(self.compacted.sparkSession, self.staged)


def compact(outputs: DataFrame, control: DataFrame | None = None, known: DataFrame | None = None,
            cache: DataFrame | None = None, limits: SkewLimits = DEFAULT_LIMITS) -> Compaction:
    """Compact outputs with references to texts seen before and notes on known paths.

    control: scope, seq, kind ('compact' or 'resume'); known: scope, path,
    added_seq; cache: entries of earlier runs, merged or not (see merge_cache).

    Two passes read the texts. The first keeps only keys and lengths; the
    second folds every distinct (text, family) once. Everything that relates
    rows to each other runs on the keys.
    """
    with collected() as staged:
        tables = _compact(outputs, control, known, cache, limits)
    return Compaction(*tables, staged)


def _compact(outputs: DataFrame, control: DataFrame | None, known: DataFrame | None, cache: DataFrame | None,
             limits: SkewLimits) -> tuple[DataFrame, ...]:
    prepared = prepare(outputs)
    key_cols = ["output_id", "ts", "seq", "scope", "cmd", "base_cmd", "family", "raw_len"]
    rows = stage(with_epoch(prepared.select(
        *key_cols,
        F.when(F.col("blank"), F.col("text")).alias("blank_text"),
        F.when(~F.col("blank"), fingerprint(F.col("stripped"))).alias("fp")), control), "rows")
    total, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("raw_len"), F.lit(0))).first()
    blank = rows.filter(F.col("fp").isNull())
    rows = rows.filter(F.col("fp").isNotNull())

    folded = stage(_fold_distinct(prepared, rows, total), "folded", TEXT_CODEC)
    secret_texts, mentions = (bool(x) for x in folded.agg(F.max("is_secret"), F.max(F.size("words") > 0)).first())
    storable = folded.filter(F.col("shrinks") & ~F.col("is_secret")).select("fp", "family")
    cached = None
    if cache is not None:
        # Only texts that occur here matter, however large the cache is.
        here = rows.select("scope", "fp").distinct()
        cached = with_epoch(
            cache.select("scope", "fp", F.col("last_storable_seq").alias("seq")).join(
                here, ["scope", "fp"], "left_semi"), control)
    own = stored_rows(rows, storable, total, limits)
    marked = stage(mark_refs(rows, first_stored(own, cached), total, limits).drop("blank_text"), "marked")
    full = marked.filter(~F.col("is_ref"))

    noted = full
    if known is None or not mentions:
        noted = noted.withColumn("notes", F.lit(None).cast("array<struct<path:string,added_seq:bigint>>"))
    else:
        words = folded.filter(F.size("words") > 0).select("fp", "family", "words")
        groups = full.select("scope", "fp", "family").distinct()
        words = join_unique(groups, words, ["fp", "family"], "scope", total, "inner", limits, counted=full)
        keys = ["scope", "family", "fp"]
        noted = join_unique(noted, path_notes(words, keys, known, limits), keys, "seq", total, "left", limits)
    again = None
    if secret_texts:
        hidden = join_unique(full, folded.filter("is_secret").select("fp", "family"), ["fp", "family"], "seq", total, "left_semi", limits)
        hidden = stage(hidden.select("output_id"), "hidden")
        few = hidden.count() <= BROADCAST_TEXTS
        again = _fold_secrets(prepare(outputs.join(F.broadcast(hidden), "output_id", "left_semi")) if few else prepared)

    def with_texts(noted: DataFrame, folded: DataFrame) -> DataFrame:
        """Rows with their folded texts, notes applied."""
        texts = folded.filter(~F.col("is_secret")).select("fp", "family", "is_secret", "shrinks", "body", "plain")
        # Every row gets its text here, so a key weighs what its texts do.
        done = join_unique(noted, texts, ["fp", "family"], "seq", chars, "inner", limits, counted=full, chars="raw_len")
        if again is not None:
            secret = folded.filter("is_secret").select("fp", "family")
            secret = join_unique(noted, secret, ["fp", "family"], "seq", total, "left_semi", limits, counted=full)
            done = done.unionByName(secret.join(again, "output_id"))
        return done.withColumn("_noted", apply_notes(F.col("body"), F.col("notes"), F.col("seq")))

    done = with_texts(noted, folded)
    # Notes may make a text longer than it was; then it stays as it was.
    outgrown = F.col("notes").isNotNull() & (F.length("_noted") >= F.length("plain"))
    # What is not noted is as long as its body, which is known.
    plain = join_unique(noted.filter(F.col("notes").isNull()), folded.select("fp", "family", "body_len"), ["fp", "family"],
                        "seq", total, "inner", limits, counted=full)
    # Only texts with mentions have notes; the log moves no others.
    with_notes = with_texts(noted.filter(F.col("notes").isNotNull()), folded.filter(F.size("words") > 0))
    log = _tokens(plain, F.col("body_len")).unionByName(_tokens(with_notes, F.length(
        F.when(outgrown, F.col("plain")).otherwise(F.col("_noted"))))).unionByName(
        _tokens(marked.filter("is_ref"), F.lit(REF_LENGTH))).unionByName(_tokens(blank, F.col("raw_len")))
    done = _finish(
        done, F.when(outgrown, F.col("plain")).otherwise(F.col("_noted")), F.col("is_secret"),
        F.when(F.col("shrinks") & ~outgrown, "compressed").otherwise("unchanged"))
    refs = _finish(marked.filter("is_ref"), ref_token(F.col("fp")), F.lit(False), F.lit("ref"))
    empty = _finish(blank, F.col("blank_text"), F.lit(False), F.lit("empty"))

    last = join_unique(full, storable, ["fp", "family"], "seq", total, "left_semi", limits)
    last = last.groupBy("scope", "fp").agg(
        F.max("seq").alias("last_storable_seq"), F.max_by("family", "seq").alias("family"),
        F.max_by("ts", "seq").alias("created_at"))
    texts = folded.select("fp", "family", "body", "stripped_len")
    entries = join_unique(last, texts, ["fp", "family"], "last_storable_seq", total, "inner", limits, counted=full).select(
        "scope", "fp", short_ref(F.col("fp")).alias("ref"), F.col("body").alias("compressed"),
        token_estimate(F.col("stripped_len")).alias("original_tokens"),
        token_estimate(F.length("body")).alias("compressed_tokens"),
        "last_storable_seq", "created_at")
    return (done.unionByName(refs).unionByName(empty), entries, log, own,
            full.select("scope", "fp", "epoch", "stale", "seq", "output_id"))


def _fold_distinct(prepared: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """One row per (fp, family) with the folded text.

    Of all copies the row with the lowest id is folded; that is found on keys alone, so no text is
    sorted or grouped, and with few texts, or few copies among many, none is shuffled.
    """
    texts = prepared.filter(~F.col("blank")).select("output_id", "family", "stripped")
    keep = rows.groupBy("fp", "family").agg(F.min("output_id").alias("output_id")).select("output_id", "fp")
    few = total <= BROADCAST_TEXTS
    if not few:
        keep = stage(keep, "distinct")
        n = keep.count()
        few = n <= BROADCAST_TEXTS
    if few or total - n > BROADCAST_TEXTS:
        distinct = texts.join(F.broadcast(keep) if few else keep.hint("shuffle_hash"), "output_id")
    else:
        copies = stage(rows.select("output_id").join(keep, "output_id", "left_anti"), "copies")
        distinct = texts.filter(F.col("output_id").isNotNull()).join(F.broadcast(copies), "output_id", "left_anti").withColumn(
            "fp", fingerprint(F.col("stripped")))
    told = ~F.col("is_secret")
    return fold_guarded(distinct).select(
        "fp", "family", "is_secret", "shrinks", F.length("stripped").alias("stripped_len"), F.length("body").alias("body_len"),
        F.when(told, F.col("body")).alias("body"), F.when(told, _plain()).alias("plain"),
        F.when(F.col("shrinks") & mentions_path(F.col("body")), mention_words(F.col("body"))).alias("words"))


def _fold_secrets(prepared: DataFrame) -> DataFrame:
    """Texts with secrets, read and folded again where they are needed, as they are staged nowhere.

    With few such rows only those come here; otherwise whether a text holds one is seen in the text, so no
    other is moved. The outer form, as a filter would make and strip every text once more for each hint.
    """
    secret = with_secret(prepared, "stripped").select(
        "output_id", "family", F.explode_outer(F.when(F.col("is_secret") & ~F.col("blank"), F.array("stripped"))).alias("stripped"))
    return fold_guarded(secret.filter(F.col("stripped").isNotNull())).select(
        "output_id", "is_secret", "shrinks", "body", _plain().alias("plain"))


def _plain() -> Column:
    """What a text falls back to if notes on paths make it too long."""
    return F.when(F.col("shrinks") & mentions_path(F.col("body")), F.col("stripped"))


def _tokens(rows: DataFrame, result_len: Column) -> DataFrame:
    return rows.select("ts", "scope", "cmd", token_estimate(F.col("raw_len")).alias("original_tokens"),
                       token_estimate(F.coalesce(result_len, F.lit(0))).alias("compressed_tokens"))


def _finish(rows: DataFrame, result, is_secret, outcome) -> DataFrame:
    return rows.select(
        *COMPACTED[:7], is_secret.alias("is_secret"), "fp", result.alias("result"),
        outcome.alias("outcome"), token_estimate(F.col("raw_len")).alias("orig_tokens"),
    ).withColumn("comp_tokens", token_estimate(F.coalesce(F.length("result"), F.lit(0))))
