"""Events, metrics, sources, and the registered queries beside their SQL."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import compare, connect
from tersefold.operators import events, metrics
from tersefold.sources import tables
from tersefold.plans import inputs, oracle, registry
from tersefold.plans.compact import compact_text
from tersefold.plans.inputs import arriving
from tersefold.session import new_dir
from tersefold.streaming.jobs import (
    CACHE_SCHEMA, FileSink, classify_stream, keep_first_stream, rolling_savings, run_parts, run_to_end, run_updates,
)

SMALL = "/root/testdata/sf0.001"


def test_parse_events(spark):
    cases = [
        ('{"tool_name": "Bash", "tool_input": {"command": "git status"}}', "git status", None),
        ('{"tool_name": "EXECUTE_BASH", "tool_input": {"command": "a", "more": [1]}}', "a", None),
        ('{"tool_name": "Read", "tool_input": {"command": "x"}}', "x", "other-tool"),
        ('{"tool_name": "Bash", "tool_input": {"command": "  "}}', "  ", "no-command"),
        ('{"tool_name": "Bash", "tool_input": {"command": ""}}', "", "no-command"),
        ('{"tool_name": "Bash", "tool_input": {}}', None, "no-command"),
        ('{"tool_name": "Bash", "tool_input": null}', None, "no-command"),
        ('{"tool_name": "Bash", "tool_input": "text"}', None, "no-command"),
        ('{"tool_name": "Bash"}', None, "no-command"),
        ('{"tool_input": {"command": "x"}}', "x", "other-tool"),
        ("null", None, "not-an-object"), ("[1]", None, "not-an-object"), ("no object", None, "invalid-json"),
        ('{"tool_name": "Bash", "tool_input": {"command": {"a": 1}}}', None, "not-a-string"),
        ('{"tool_name": "Bash", "tool_input": {"command": 5}}', None, "not-a-string"),
        ("", None, "invalid-json"), ('{"tool_name": "Bash"', None, "invalid-json"),
    ]
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(cases)], "i int, value string")
    got = [(r.command, r.reject_reason) for r in events.parse_events(df).orderBy("i").collect()]
    assert [r for _, r in got] == [r for _, _, r in cases]
    assert [c for c, r in got if r is None] == [c for _, c, r in cases if r is None]


def test_skip_report_counts_all(spark):
    df = spark.createDataFrame([("a && b",), ("vim x",), ("ls",), ("ls",)], "command string")
    got = {r.skip_reason: r.commands for r in events.skip_report(events.classify(df)).collect()}
    assert got == {"shell-op:&&": 1, "interactive": 1, "eligible": 2}


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "ts_s long, scope string, cmd string, original_tokens long, compressed_tokens long"
                                 ).select(F.timestamp_seconds("ts_s").alias("ts"), "scope", "cmd", "original_tokens",
                                          "compressed_tokens")


def test_lookback(spark):
    now = F.timestamp_seconds(F.lit(1_000_000))
    rows = [(1_000_000 - 24 * 3600, "s", "a", 354, 41), (1_000_000 - 24 * 3600 - 1, "s", "a", 9, 1), (999_999, "s", "b", 46, 44)]
    assert tuple(metrics.lookback_stats(log_rows(spark, rows), now).first()) == (2, 400, 85, 315, 78.8)
    assert tuple(metrics.lookback_stats(log_rows(spark, rows[:0]), now).first()) == (0, 0, 0, 0, 0.0)
    one = metrics.row_reduction(log_rows(spark, [(1, "s", "a", 354, 41), (1, "s", "a", 3, 3), (1, "s", "a", 2413, 6)]))
    assert [r.reduction_pct for r in one.orderBy("original_tokens").collect()] == [None, 88.0, 100.0]


def test_log_sink_is_pruned_by_day(spark):
    path = new_dir(spark, "log")
    rows = [(86400 * d, "s", "a", 10 * d, d) for d in range(1, 5)]
    tables.append_log(log_rows(spark, rows[:2]), path)
    tables.append_log(log_rows(spark, rows[2:]), path)
    back = tables.read_log(spark, path, since=dt.datetime(1970, 1, 4))
    assert back.count() == 2
    assert "PartitionFilters: [isnotnull(day" in back._jdf.queryExecution().executedPlan().toString()


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(2000)))
    (tmp_path / "b.log").write_text("x\r\n\ny\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = tables.read_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    a = sorted((r.pos, r.line) for r in lines if r.path.endswith("a.log"))
    assert a == [(i, f"line {i}\n") for i in range(2000)]
    assert sorted((r.pos, r.line) for r in lines if r.path.endswith("b.log")) == [(0, "x\r\n"), (1, "\n"), (2, "y\n")]
    whole = {r.path[-5:]: r.text for r in tables.read_outputs(spark, str(tmp_path)).collect()}
    assert whole["b.log"] == "x\r\n\ny\n" and len(whole) == 2


def test_outputs_arriving_as_files(spark, tmp_path):
    (tmp_path / "a.out").write_text("same\n" * 3)
    stream = tables.stream_outputs(spark, str(tmp_path)).withColumn("cmd", F.lit("ls"))
    got = run_to_end(compact_text(stream)).collect()
    assert [(r.result, r.outcome) for r in got] == [("same (×3)\n", "compressed")]


def test_cache_sink_last_write_wins(spark):
    path = new_dir(spark, "cache")
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    old = spark.createDataFrame([("s", "f", "r", "old", 9, 2, 1, at(1)), ("s", "g", "q", "kept", 9, 2, 2, at(2))], CACHE_SCHEMA)
    new = spark.createDataFrame([("s", "f", "r", "new", 9, 3, 7, at(5)), ("t", "f", "r", "else", 9, 3, 8, at(5))], CACHE_SCHEMA)
    tables.write_cache(old, new, path)
    got = sorted((r.scope, r.fp, r.compressed) for r in spark.read.parquet(path).collect())
    assert got == [("s", "f", "new"), ("s", "g", "kept"), ("t", "f", "else")]


def test_known_sink_first_add_wins(spark):
    path = new_dir(spark, "known")
    schema = "scope string, path string, added_seq long"
    old = spark.createDataFrame([("s", "a.py", 5)], schema)
    new = spark.createDataFrame([("s", "a.py", 9), ("s", "b.py", 7)], schema)
    tables.write_known(old, new, path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("s", "a.py", 5), ("s", "b.py", 7)]


def test_late_rows_meet_the_watermark(spark):
    """Rows behind the watermark are dropped, and state behind it is forgotten."""
    # What is late in a batch is judged by the watermark that the batch before it began with.
    log = log_rows(spark, [(3600 * h, "s", str(b), 10, 5) for b, h in enumerate([1, 50, 51, 1, 52])])
    parts = [F.col("cmd") == str(b) for b in range(5)]
    got = {r.window_start.timestamp() // 3600: r.compressions for r in run_updates(
        rolling_savings(arriving(log, parts), "1 hour", "1 hour"), "window_start", "window_end").collect()}
    assert got == {1: 1, 50: 1, 51: 1, 52: 1}
    rows = [(0, 5, "x"), (1, 100, "y"), (2, 101, "w"), (3, 6, "z"), (4, 102, "x")]
    outputs = spark.createDataFrame(
        [(i, 3600 * h, i, "s", "ls", t) for i, h, t in rows], "output_id long, ts_s long, seq long, scope string, cmd string, text string"
    ).withColumn("ts", F.timestamp_seconds("ts_s"))
    stream = arriving(outputs, [F.col("output_id") == i for i in range(5)])
    # Row 3 is late; row 4 repeats a text whose state is gone.
    assert sorted(r.output_id for r in run_to_end(keep_first_stream(stream, "10 hours")).collect()) == [0, 1, 2, 4]


def test_stream_first_over_long_times(spark, tmp_path):
    """Ids far apart: parts are as long as ever, and what is forgotten is what the SQL forgets."""
    docs = [(5, "same old text"), (299_945, "early"), (600_005, "same old text"), (600_065, "late"), (600_066, None)]
    folder = tmp_path / "documents.parquet"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet' WHERE text IS NOT NULL")
    got = [tuple(r) for r in registry.QUERIES["stream_first"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(oracle.SQL["stream_first"]).fetchall()) and len(got) == len(set(got))


def test_rows_of_no_part_are_told_by_the_caller_and_none_is_lost(spark):
    log = log_rows(spark, [(3600 * h if h else None, "s", "a", 10, 5) for h in (1, 2, 3, None, 9)]).withColumn("_s", F.unix_seconds("ts"))
    quarter = inputs.quarter("_s", log)
    assert sorted(r[0] for r in log.select(quarter).collect()) == [0, 0, 0, 0, 3]
    sink, seen = FileSink(spark), []
    run_parts(log, [quarter == k for k in range(4)], lambda stream: seen.append(sink.run(stream.select("cmd")).count()))
    assert seen[-1] == 5 and seen == sorted(seen)


def test_log_holds_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert tables.read_log(spark, path).count() == 0
    rows = [(86400 * d, "s", "a", 10 * d, d) for d in range(1, 5)]
    assert tables.append_log(log_rows(spark, rows[:2]), path, 7)
    assert not tables.append_log(log_rows(spark, rows[:2]), path, 7)
    # An attempt that ended before its commit, and the one that follows it.
    log_rows(spark, rows[2:]).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{path}/data/attempt=x")
    assert tables.read_log(spark, path).count() == 2
    assert tables.append_log(log_rows(spark, rows[2:]), path, "8/8")
    assert sorted(r.original_tokens for r in tables.read_log(spark, path).collect()) == [10, 20, 30, 40]
    assert tables.read_log(spark, path, dt.datetime(1970, 1, 5)).count() == 1
    assert tables.append_log(log_rows(spark, []), path, "empty") and tables.read_log(spark, path).count() == 4


def test_log_has_few_files_however_many_tasks_bring_it(spark, tmp_path):
    log = spark.range(4000).repartition(16).select(
        F.expr("timestamp_seconds(1704067200 + id % 20 * 86400)").alias("ts"), F.lit("s").alias("scope"), F.lit("ls").alias("cmd"),
        F.col("id").alias("original_tokens"), F.col("id").alias("compressed_tokens"))
    tables.append_log(log, str(tmp_path), "b")
    assert len(list((tmp_path / "data").rglob("*.parquet"))) == 20
    assert tables.read_log(spark, str(tmp_path)).agg(F.sum("original_tokens")).first()[0] == 4000 * 3999 // 2


def test_windows_from_hourly_sums_equal_the_log(spark):
    rng = random.Random(3)
    rows = [(rng.choice([rng.randrange(400_000), 7200, None]), "s", "a", rng.randrange(100), rng.randrange(50)) for _ in range(500)]
    log = log_rows(spark, rows)
    edges = [sorted(rng.choice([rng.randrange(-9000, 450_000), 3600 * rng.randrange(120)]) for _ in range(2)) for _ in range(80)]
    windows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(edges)], "window_id long, a long, b long").select(
        "window_id", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"))
    sums = metrics.merge_sums(metrics.hourly_sums(log.filter("original_tokens > 50")), metrics.hourly_sums(log.filter("original_tokens <= 50")))
    got = {r.window_id: (r.compressions, r.original_tokens, r.tokens_saved) for r in metrics.window_savings(windows, log, sums).collect()}
    for k, (a, b) in enumerate(edges):
        inside = [r for r in rows if r[0] is not None and a <= r[0] < b]
        assert got[k] == (len(inside), sum(r[3] for r in inside), sum(r[3] - r[4] for r in inside))
    empty = metrics.window_savings(windows, log.limit(0), metrics.hourly_sums(log.limit(0))).collect()
    assert len(empty) == 80 and all(r.compressions == 0 and r.reduction_pct == 0 for r in empty)


def test_streams_take_the_guards(spark):
    events_ = spark.createDataFrame([('{"tool_name": "Bash", "tool_input": {"command": "wrap ls"}}',),
                                     ('{"tool_name": "Bash", "tool_input": {"command": "me x"}}',)], "value string")
    got = run_to_end(classify_stream(arriving(events_, [F.lit(True)]), "wrap ", ["me"]))
    assert sorted(r.skip_reason for r in got.collect()) == ["already-compressed", "self"]


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracle.SQL)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SMALL), name, registry.QUERIES[name], oracle.SQL[name], SMALL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "tokens_saved" in df.columns
