"""The registered queries: name to function of (session, folder of the tables)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.commands import base_command
from ..operators import dedup, events, folds_doc, folds_lines, metrics, refs
from ..operators.epochs import with_epoch
from ..operators.runs import BLOCK_ROWS
from ..session import TEXT_CODEC, new_dir, remove, stage
from ..sources import tables
from ..sources.lines import read_lines
from ..streaming import jobs
from . import inputs
from .compact import Compaction, compact, compact_text
from .compact_lines import compact_lines
from .techniques import reduction_by_technique as technique_savings


def _whole(spark: SparkSession, sf_dir: str) -> Compaction:
    outputs = inputs.outputs(spark, sf_dir)
    return compact(outputs, inputs.control(spark), refs.known_paths(outputs))


def ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.outputs(spark, sf_dir).select("output_id", T.strip_ansi(F.col("text")).alias("stripped"))


def blank_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), T.is_blank(F.col("line")).alias("blank"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.text_table(spark, sf_dir, "documents", "doc_id", "text")
    return T.with_secret(docs, "text").drop("text")


def blank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.outputs(spark, sf_dir).select(
        "output_id", T.collapse_blank_lines(F.col("text")).alias("collapsed"))


def collapse_runs_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.text_table(spark, sf_dir, "documents", "doc_id", "text")
    return folds_doc.collapse_repeats(docs, "text", "folded").drop("text")


def collapse_runs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds_lines.collapse_repeats(inputs.conversation_lines(spark, sf_dir))


def fold_diff_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds_lines.fold_diff(inputs.diff_lines(spark, sf_dir))


def fold_build_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds_lines.fold_build(inputs.build_lines(spark, sf_dir))


def fold_package_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds_lines.fold_package(inputs.package_lines(spark, sf_dir))


def extract_test_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds_lines.extract_test_failures(inputs.test_lines(spark, sf_dir))


def json_strip_minify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds_doc.minify_json(inputs.json_outputs(spark, sf_dir), "text", "minified").drop("text")


def truncate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds_doc.cut_lines(inputs.long_outputs(spark, sf_dir), "text", "cut").drop("text")


def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = folds_doc.cut_bytes(inputs.wide_outputs(spark, sf_dir), "text", "cut")
    return cut.select("output_id", F.md5("cut").alias("cut_md5"))


def base_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.commands(spark, sf_dir).select("event_id", base_command(F.col("command")).alias("base_cmd"))


def skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.classify(inputs.commands(spark, sf_dir))


def skip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.skip_report(skip_reason(spark, sf_dir))


def parse_tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.parse_events(inputs.tool_events(spark, sf_dir)).select(
        "event_id", "tool_name", "command", "reject_reason")


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents").select(
        "doc_id", dedup.fingerprint(F.col("text")).alias("fp"))
    return docs.withColumn("ref", dedup.short_ref(F.col("fp")))


def dedup_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = compact(inputs.outputs(spark, sf_dir), inputs.control(spark)).compacted
    return done.select("output_id", "seq", "fp", "family", (F.col("outcome") == "ref").alias("is_ref"))


def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, one per reading: the cache of the first serves the second and takes what that adds."""
    outputs, control = inputs.outputs(spark, sf_dir), inputs.control(spark)
    first = stage(compact(outputs.filter(F.col("seq") < 2 * inputs.PASS), control).cache_entries, "cache")
    second = compact(outputs.filter(F.col("seq") >= 2 * inputs.PASS), control, cache=first).cache_entries
    merged = dedup.merge_cache(first, second)
    return merged.withColumn("created_s", F.unix_seconds("created_at")).drop("created_at")


def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _whole(spark, sf_dir)
    rows = stage(done.compacted.select("output_id", "scope", "seq", "result"), "compacted")
    return dedup.resolve_refs(rows, dedup.merge_cache(None, done.cache_entries)).select(
        "output_id", "content", "ref_matches")


def known_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.known_paths(inputs.ref_outputs(spark, sf_dir))


def annotate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = inputs.ref_outputs(spark, sf_dir)
    return refs.annotate(outputs, refs.known_paths(outputs)).select(
        "output_id", F.col("text").alias("annotated"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", T.token_estimate(F.length("text")).alias("tokens"))


def row_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.row_reduction(inputs.compaction_log(spark, sf_dir)).select(
        F.unix_seconds("ts").alias("ts_s"), "original_tokens", "compressed_tokens", "reduction_pct")


def lookback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last week before the newest entry."""
    log = inputs.compaction_log(spark, sf_dir)
    newest = log.agg(F.max("ts")).first()[0]
    return metrics.lookback_stats(log, F.lit(newest), hours=168)


def lookback_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-backs from every tenth entry, of half an hour to four days, from sums of two halves of the log."""
    log = inputs.compaction_log(spark, sf_dir)
    early = F.col("original_tokens") % 2 == 0
    sums = stage(metrics.merge_sums(metrics.hourly_sums(log.filter(early)), metrics.hourly_sums(log.filter(~early))), "sums")
    windows = inputs.table(spark, sf_dir, "documents").filter(F.col("doc_id") % 10 == 0).select(
        F.col("doc_id").alias("window_id"), F.expr(f"timestamp_seconds({inputs.START} + 3600 * doc_id - 1800 * (doc_id % 193 + 1))").alias("start"),
        F.expr(f"timestamp_seconds({inputs.START} + 3600 * doc_id + doc_id % 7 * 600)").alias("end"))
    return metrics.window_savings(windows, log, sums)


def stats_by_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stats_by(_whole(spark, sf_dir).log, "cmd")


def reduction_by_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technique_savings(inputs.outputs(spark, sf_dir))


def compact_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).compacted.select(
        "output_id", "seq", "fp", "family", "result", "outcome", "is_secret", "orig_tokens", "comp_tokens")


_STATELESS = ["output_id", "seq", "family", "is_secret", "result", "outcome", "orig_tokens", "comp_tokens"]


def compact_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_text(inputs.outputs(spark, sf_dir)).select(_STATELESS)


def stream_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = inputs.outputs_of(inputs.stream(spark, sf_dir, "documents"))
    return jobs.run_to_end(jobs.compact_stream(outputs).select(_STATELESS))


def _dedup_in_batches(spark: SparkSession, outputs: DataFrame, comes: Column) -> DataFrame:
    """Four batches by `comes`, a seq; control events arrive between them, known paths and cache come from the batches before."""
    landing, progress = new_dir(spark, "landing"), new_dir(spark, "progress")
    state, out, events = new_dir(spark, "state"), new_dir(spark, "stream"), new_dir(spark, "control")
    run = jobs.dedup_batches(state, out, events)
    ends = [0, *[2 * (inputs.PASS + k) for k in (0, 150, 200)], 4 * inputs.PASS]
    control = inputs.control(spark)
    for begin, end in zip(ends, ends[1:]):
        part = lambda at: (F.coalesce(at, F.lit(0)) >= begin) & (F.coalesce(at, F.lit(0)) < end)  # noqa: B023, E731
        control.filter(part(F.col("seq"))).coalesce(1).write.mode("append").parquet(events)
        outputs.filter(part(comes)).write.mode("append").parquet(landing, compression=TEXT_CODEC)
        jobs.run_batches(spark.readStream.schema(outputs.schema).parquet(landing), progress, run)
        # What has been processed is not read again.
        remove(spark, [landing])
    return jobs.read_results(spark, state, out).select("output_id", "seq", "fp", "outcome", F.md5("result").alias("result_md5"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup_in_batches(spark, inputs.outputs(spark, sf_dir), F.col("seq"))


def stream_dedup_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows come one batch or more too late: what they change is corrected."""
    outputs = inputs.outputs(spark, sf_dir)
    doc, late = F.expr("output_id div 2"), F.lit(2 * inputs.PASS)
    comes = F.when((doc % 6 != 5) & (doc % 7 == 3), F.col("seq") + late).when(
        (doc % 6 != 5) & (doc % 7 == 4) & (F.col("seq") < late), late + 2 * 160).otherwise(F.col("seq"))
    return _dedup_in_batches(spark, outputs, F.least(comes, F.lit(4 * inputs.PASS - 1)))


def stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches, ten days apart, under a delay of four: a text of the part before is a copy, an older one is forgotten.

    Rows that come two parts too late are behind the watermark.
    """
    outputs = inputs.parted_outputs(spark, sf_dir)
    parts = [F.col("comes") == k for k in range(inputs.PARTS)]
    sink, found = jobs.FileSink(spark), []
    jobs.run_parts(outputs, parts, lambda stream: found.append(sink.run(
        jobs.keep_first_stream(stream, "4 days").select("scope", "fp", "ts"))))
    part = F.expr(f"(unix_seconds(ts) - {inputs.START}) div {86_400 * inputs.PART_DAYS}")
    return found[-1].select("scope", "fp", part.alias("part"))


def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches in the order of time; windows behind the watermark are done with, also for rows that come late."""
    log = inputs.compaction_log(spark, sf_dir).withColumn("_s", F.unix_seconds("ts"))
    log = log.withColumn("_comes", F.when(F.col("original_tokens") % inputs.LATE_OF == 0, 3).otherwise(inputs.quarter("_s", log)))
    sink, found = jobs.UpdateSink(spark, "window_start", "window_end"), []
    jobs.run_parts(log, [F.col("_comes") == k for k in range(4)],
                   lambda stream: found.append(sink.run(jobs.rolling_savings(stream))))
    return found[-1].select(F.unix_seconds("window_start").alias("window_start_s"), "compressions", "original_tokens",
                            "compressed_tokens", "tokens_saved", "reduction_pct")


def skip_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that are wrapped already or are the tool itself."""
    return events.classify(inputs.commands(spark, sf_dir), inputs.WRAP_MARKER, inputs.OWN_NAMES)


def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a compaction, appended as a batch, once more as a retry of it, and read back from a day on.

    An attempt that was not committed lies beside it.
    """
    path = new_dir(spark, "log")
    done = compact(inputs.outputs(spark, sf_dir), inputs.control(spark))
    for batch in ("first", "first"):
        tables.append_log(done.log, path, batch)
    done.log.limit(100).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{path}/data/attempt=broken")
    done.close()
    since = datetime.fromtimestamp(inputs.START + 2_592_000, timezone.utc)
    return metrics.stats_by(tables.read_log(spark, path, since), "cmd")


def cache_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache as the second of two snapshots, each written from the one before."""
    outputs, control, paths = inputs.outputs(spark, sf_dir), inputs.control(spark), []
    for part in (F.col("seq") < 2 * inputs.PASS, F.col("seq") >= 2 * inputs.PASS):
        old = spark.read.parquet(paths[-1]) if paths else None
        done = compact(outputs.filter(part), control, cache=old)
        paths.append(new_dir(spark, "cache"))
        tables.write_cache(old, done.cache_entries, paths[-1])
        done.close()
    return spark.read.parquet(paths[-1]).select("scope", "fp", "ref", "last_storable_seq")


def known_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known paths as a snapshot of the later half merged with the earlier."""
    outputs, path = inputs.ref_outputs(spark, sf_dir), new_dir(spark, "known")
    early = F.col("output_id") % 2 == 0
    tables.write_known(refs.known_paths(outputs.filter(~early)), refs.known_paths(outputs.filter(early)), path)
    return spark.read.parquet(path)


def _group(path: str = "path") -> Column:
    return F.regexp_extract(path, r"/g=([0-9-]+)/", 1).cast("long")


def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of conversations, read back as one output each and compacted."""
    read = tables.read_outputs(spark, f"{inputs.turn_files(spark, sf_dir)}/*/*.txt").select(
        _group().alias("id"), F.lit("cat x").alias("cmd"), "text")
    return compact_text(read).select("id", "is_secret", "outcome", "orig_tokens", "comp_tokens", F.md5("result").alias("result_md5"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of large files, read in ranges that end anywhere."""
    lines = read_lines(spark, inputs.log_files(spark, sf_dir), 1 << 20)
    return lines.select(_group().alias("id"), "pos", F.md5("line").alias("line_md5"))


def _by_lines(outputs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Outputs as line tables, compacted in line form and joined to texts again."""
    lines = T.with_lines(outputs.select("output_id", "text"), "text", "lines").select("output_id", F.posexplode_outer("lines").alias("pos", "line"))
    lines = lines.filter(F.col("pos").isNotNull()).select("output_id", F.col("pos").cast("long").alias("pos"), "line")
    done = compact_lines(lines, outputs.select("output_id", "cmd"), block_rows)
    texts = done.groupBy("output_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return texts.select("output_id", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "")).alias("result_md5"))


def compact_line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_lines(inputs.outputs(spark, sf_dir))


def compact_over_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes and JSON over many lines, and all line ends, in blocks of few lines."""
    return _by_lines(inputs.over_lines_outputs(spark, sf_dir), 64)


def compact_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that nothing fits: none is lost and none fails."""
    return compact_text(inputs.odd_outputs(spark, sf_dir)).select(
        "output_id", "outcome", "orig_tokens", "comp_tokens", F.md5("result").alias("result_md5"))


def control_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of every event under more control events than are broadcast."""
    rows = inputs.table(spark, sf_dir, "events").filter(~F.col("event_type").isin("error", "purchase")).select(
        "event_id", F.col("user_id").cast("string").alias("scope"), F.col("event_id").alias("seq"))
    return with_epoch(rows, inputs.many_control(spark, sf_dir)).select("event_id", "epoch", "stale")


def stream_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = inputs.tool_events_of(inputs.stream(spark, sf_dir, "events"))
    return jobs.run_to_end(jobs.classify_stream(stream)).select(
        "event_id", "reject_reason", "base_cmd", "skip_reason")


QUERIES = {
    "ansi_strip": ansi_strip,
    "blank_guard": blank_guard,
    "secret_scan": secret_scan,
    "blank_collapse": blank_collapse,
    "collapse_runs_doc": collapse_runs_doc,
    "collapse_runs_lines": collapse_runs_lines,
    "fold_build_lines": fold_build_lines,
    "fold_package_lines": fold_package_lines,
    "fold_diff_context": fold_diff_context,
    "extract_test_failures": extract_test_failures,
    "json_strip_minify": json_strip_minify,
    "truncate_lines": truncate_lines,
    "truncate_bytes": truncate_bytes,
    "base_command": base_commands,
    "skip_reason": skip_reason,
    "skip_report": skip_report,
    "parse_tool_events": parse_tool_events,
    "fingerprint": fingerprint,
    "dedup_asof": dedup_asof,
    "cache_merge": cache_merge,
    "resolve_refs": resolve_refs,
    "known_paths": known_paths,
    "annotate_refs": annotate_refs,
    "token_estimate": token_estimate,
    "row_reduction": row_reduction,
    "lookback_stats": lookback_stats,
    "lookback_windows": lookback_windows,
    "stats_by_command": stats_by_command,
    "reduction_by_technique": reduction_by_technique,
    "compact_outputs": compact_outputs,
    "compact_text": compact_each,
    "stream_compact": stream_compact,
    "stream_dedup": stream_dedup,
    "stream_dedup_late": stream_dedup_late,
    "stream_first": stream_first,
    "stream_stats": stream_stats,
    "stream_skip": stream_skip,
    "skip_guarded": skip_guarded,
    "log_roundtrip": log_roundtrip,
    "cache_snapshot": cache_snapshot,
    "known_merge": known_merge,
    "text_source": text_source,
    "log_lines": log_lines,
    "control_epochs": control_epochs,
    "compact_lines": compact_line_tables,
    "compact_over_lines": compact_over_lines,
    "compact_odd": compact_odd,
}
