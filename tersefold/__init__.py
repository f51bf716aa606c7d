"""Compaction of command output and log text as Spark DataFrame jobs."""

from .operators.dedup import merge_cache, resolve_refs
from .operators.events import classify, parse_events, skip_report
from .operators.metrics import hourly_sums, lookback_stats, merge_sums, stats_by, window_savings
from .operators.refs import annotate, known_paths, merge_known
from .plans.compact import Compaction, compact, compact_text
from .plans.compact_lines import compact_lines
from .plans.techniques import reduction_by_technique
from .sources.lines import read_lines
from .sources.tables import (
    append_log, read_log, read_log_lines, read_outputs, stream_outputs, write_cache, write_known,
)
from .streaming.jobs import (
    classify_stream, compact_stream, dedup_batches, keep_first_stream, read_cache, read_results, rolling_savings,
)

__all__ = [
    "Compaction", "annotate", "append_log", "classify", "classify_stream", "compact", "compact_lines", "compact_stream", "compact_text",
    "dedup_batches", "hourly_sums", "keep_first_stream", "known_paths", "lookback_stats", "merge_cache", "merge_known", "merge_sums",
    "parse_events", "read_cache", "read_lines", "read_log", "read_log_lines", "read_outputs", "read_results", "reduction_by_technique",
    "resolve_refs", "rolling_savings", "skip_report", "stats_by", "stream_outputs", "window_savings", "write_cache", "write_known",
]
