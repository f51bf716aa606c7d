"""Outputs, line tables, commands and logs derived from the given tables.

Everything is a projection of the table it comes from, so it grows with it and
needs no shuffle. Positions come from ids, not from numbering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import with_lines
from ..operators.folds_lines import number_lines
from ..session import new_dir

START = 1_704_067_200
PASS = 1_000_000_000_000
LINES_PER_OUTPUT = 200
# Parts in which outputs arrive, and how far they are apart.
PARTS, PART_DAYS = 5, 10
# Log entries whose tokens are a multiple of this come last.
LATE_OF = 40
# Ids in a row that share a text file.
LOG_DOCUMENTS, CONVERSATIONS = 2000, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work on whole texts; a table of few splits is spread over all cores."""
    df = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, spread like text_table; as a pattern the path may be a file or a folder."""
    given = table(spark, sf_dir, name)
    df = spark.readStream.schema(given.schema).parquet(f"{sf_dir}/{name}.parquet*")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if given.rdd.getNumPartitions() < cores else df


def arriving(rows: DataFrame, parts: list[Column]) -> DataFrame:
    """The rows as a stream that brings one part after another, each as a batch of its own."""
    spark = rows.sparkSession
    landing = new_dir(spark, "landing")
    for part in parts:
        rows.filter(part).coalesce(1).write.mode("append").parquet(landing)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landing)


def quarter(column: str, rows: DataFrame) -> Column:
    """0 to 3: the part of the column's range that a row is in, of about the same length each; rows without value are in the first."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    # A minimum passes over nulls, so they are filled first.
    part = F.coalesce(F.expr(f"({column} - {low or 0}) * 4 div {(high or 0) - (low or 0) + 1}"), F.lit(0))
    return F.least(part, F.lit(3))


def _s(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _repeat(text: str, n: Column) -> Column:
    return F.repeat(F.lit(text), n.cast("int"))


def _json_string(text: Column) -> Column:
    """The text as a JSON string, one accented letter of it escaped."""
    array = F.to_json(F.array(text))
    return F.replace(F.substring(array, F.lit(2), F.length(array) - 2), F.lit("\u00e9"), F.lit("\\u00e9"))


def outputs_of(documents: DataFrame) -> DataFrame:
    """Each document as command output, read twice; six commands, every third one coloured."""
    d, text = F.col("doc_id"), F.col("text")
    kind = d % 6
    cmd = (
        F.when(kind == 0, "git diff").when(kind == 1, "cargo build")
        .when(kind == 2, "/usr/bin/pytest -q").when(kind == 3, "npm install")
        .when(kind == 4, "curl -s host").otherwise(_s("cat src/f", (d % 10).cast("string"), ".py"))
    )
    body = (
        F.when(kind == 0, _s("diff --git a/f b/f\n", F.replace(text, F.lit(". "), F.lit(".\n "))))
        .when(kind == 1, _s(_repeat("   Compiling dep v1.0\n", d % 7), text, "\n   Compiling app v2.0\n --> src/f",
                            (d % 10).cast("string"), ".py:3:1\nat src/f", (d % 7).cast("string"), ".py:10\n"))
        .when(kind == 2, _s("platform linux\n", _repeat("PASSED tests/a\n", d % 5), "collected 3 items\n", text,
                            "\nFAILED tests/x\n", text, "\nPASSED tests/z\n"))
        .when(kind == 3, _s(_repeat("npm WARN deprecated\n", d % 4), text,
                            "\nadded 3 packages\nfound 0 vulnerabilities\n"))
        .when(d % 12 == 4, _s('{"id": ', d.cast("string"), ', "note": null, "tags": [null, "', F.col("lang"),
                              '", null], "user": {"n": ', F.col("n_chars").cast("string"), ', "bio": null}, "text": ',
                              _json_string(text), "}"))
        .when(kind == 4, _s(text, _repeat("\nWARNING: deprecated call", d % 20)))
        .otherwise(F.replace(text, F.lit(" "), F.lit("\n")))
    )
    coloured = _s("\x1b[32m", body, "\x1b[0m", F.repeat(F.lit("\n"), 5), "end")
    return documents.select(
        d.alias("output_id"),
        cmd.alias("cmd"),
        F.when(d % 3 == 0, coloured).otherwise(body).alias("text"),
        F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("pass"),
    ).select(
        (F.col("output_id") * 2 + F.col("pass")).alias("output_id"),
        (START + 60 * F.col("output_id") + 2_592_000 * F.col("pass")).alias("ts_s"),
        (2 * (F.col("pass") * PASS + F.col("output_id"))).alias("seq"),
        F.lit("all").alias("scope"), "cmd", "text",
    ).withColumn("ts", F.timestamp_seconds("ts_s"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs_of(text_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars"))


def parted_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs dealt to PARTS parts of an hour, PART_DAYS apart, so a part is as long whatever the table's size.

    The readings of a document go to parts of their own; some that belong to a
    part come with the one two parts later.
    """
    d = F.expr("output_id div 2")
    part = F.expr(f"(output_id div 2) div if(output_id % 2 = 0, 7, 5) % {PARTS}")
    rows = outputs(spark, sf_dir).withColumn("part", F.coalesce(part, F.lit(0)).cast("int"))
    late = (d % 11 == 3) & (F.col("part") < PARTS - 2)
    return rows.withColumn("ts_s", START + 86_400 * PART_DAYS * F.col("part") + d % 3600).withColumn(
        "ts", F.timestamp_seconds("ts_s")).withColumn("comes", F.col("part") + F.when(late, 2).otherwise(0))


# Control events lie between rows of the second reading.
CONTROL = [(100, "compact"), (150, "resume"), (180, "compact"), (220, "resume"), (700, "compact")]


def control(spark: SparkSession) -> DataFrame:
    rows = [("all", 2 * (PASS + k) + 1, kind) for k, kind in CONTROL]
    return spark.createDataFrame(rows, "scope string, seq long, kind string")


def many_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control events of every user: a compact for each error, a resume for each purchase."""
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase")).select(
        F.col("user_id").cast("string").alias("scope"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "compact").otherwise("resume").alias("kind"))


def _event_lines(events: DataFrame, line: Column) -> DataFrame:
    """One line per event; every LINES_PER_OUTPUT ids in a row are one output."""
    e = F.col("event_id")
    return events.select(
        F.expr(f"event_id div {LINES_PER_OUTPUT}").alias("output_id"),
        (e % LINES_PER_OUTPUT).alias("pos"), _s(line, "\n").alias("line"))


def build_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    return _event_lines(
        table(spark, sf_dir, "events").select("event_id", "event_type"),
        F.when(F.col("event_type") == "error", _s("error[E", e, "]: mismatched types"))
        .otherwise(_s("   Compiling part-", e, " v1")))


def package_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = F.col("event_id").cast("string"), F.col("event_type")
    return _event_lines(
        table(spark, sf_dir, "events").select("event_id", "event_type"),
        F.when(kind == "error", _s("npm ERR! code E", e)).when(kind == "view", _s("npm WARN deprecated part-", e))
        .when(kind == "click", _s("added ", e, " packages")).when(kind == "signup", "packages are funding")
        .otherwise(_s("found ", e, " issues")))


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = F.col("event_id").cast("string"), F.col("event_type")
    return _event_lines(
        table(spark, sf_dir, "events").select("event_id", "event_type"),
        F.when(kind == "error", _s("+add ", e)).when(kind == "view", _s("\tctx ", e)).otherwise(_s(" ctx ", e)))


def test_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = F.col("event_id").cast("string"), F.col("event_type")
    return _event_lines(
        table(spark, sf_dir, "events").select("event_id", "event_type"),
        F.when(kind == "view", _s("PASSED tests/t.py::t", e)).when(kind == "click", _s("tests/t.py line ", e))
        .when(kind == "signup", _s("  collected ", e, " items")).when(kind == "purchase", _s(e, " passed so far"))
        .when(F.col("event_id") % 5 == 0, _s("FAILED tests/t.py::t", e)).otherwise(_s("E   assert ", e)))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one log: a line for the role and the lines of the text, turn after turn."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("output_id"), "turn", _s("[", F.col("role"), "]\n", F.col("text")).alias("text"))
    # The outer form, as the plain one would split every text once more to see if it has lines.
    lines = with_lines(turns, "text", "lines").select("output_id", "turn", F.posexplode_outer("lines").alias("row", "line"))
    closed = F.when(F.col("line").endswith("\n"), F.col("line")).otherwise(_s(F.col("line"), "\n"))
    lines = lines.filter(F.col("row").isNotNull()).withColumn("line", closed)
    return number_lines(lines, "output_id", "turn", "row").select("output_id", "pos", "line")


def json_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = text_table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    return e.select(
        F.col("event_id").alias("output_id"),
        _s('{"id": ', F.col("event_id").cast("string"), ', "note": null, "tags": [null, "', F.col("event_type"),
           '", null, "a\\u00e9\\/b"], "user": {"id": ', F.col("user_id").cast("string"),
           ', "bio": null, "rate": 1.50}, "none": [null]}').alias("text"))


def line_end_text(doc_id: Column, text: Column) -> Column:
    """The text with carriage returns, other line ends, empty lines and an escape behind a carriage return."""
    words = F.replace(text, F.lit(" "), F.lit("\r"))
    return _s("step 1\r\n\n\n\n", words, "\r\x1b[0m\n\x0b\n\n\n\x85\n", F.replace(text, F.lit(". "), F.lit(".\u2028")),
              "\r\r\r\r", doc_id.cast("string"))


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of large text files with all kinds of line ends: one of every LOG_DOCUMENTS ids in a row, in order."""
    d = F.col("doc_id")
    docs = text_table(spark, sf_dir, "documents", "doc_id", "text").withColumn("g", F.expr(f"doc_id div {LOG_DOCUMENTS}"))
    path = new_dir(spark, "logs")
    # The longer texts of the files are made behind the shuffle.
    (docs.repartition("g").sortWithinPartitions("g", "doc_id").select("g", line_end_text(d, F.col("text")).alias("value"))
     .write.partitionBy("g").option("lineSep", "\x1e").text(path))
    return path


def turn_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of text files with the turns of every CONVERSATIONS conversations in a row."""
    turns = text_table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        F.expr(f"conv_id div {CONVERSATIONS}").alias("g"), "conv_id", "turn", F.col("text").alias("value"))
    path = new_dir(spark, "texts")
    (turns.repartition("g").sortWithinPartitions("g", "conv_id", "turn", "value").select("g", "value")
     .write.partitionBy("g").text(path))
    return path


def over_lines_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a text whose escapes, JSON or line ends do not keep to lines."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", "text")
    d, text = F.col("doc_id"), F.col("text")
    spread = F.replace(text, F.lit(" "), F.lit("\n"))
    escaped = F.replace(F.replace(spread, F.lit("\nthe\n"), F.lit("\n\x1b]0;the\n")), F.lit(".\n"), F.lit(".\x07\n"))
    return docs.select(d.alias("output_id"), F.lit("curl -s host").alias("cmd"), (
        F.when(d % 5 == 0, _s('\n{\n  "id": ', d.cast("string"), ',\n  "note": null,\n  "tags": [\n    null,\n    "x"\n  ],\n  "text": ',
                              _json_string(text), _repeat(",\n  \"gone\": null", d % 200), "\n}\n\n"))
        .when(d % 5 == 1, _s("a\x1b[32m\x1b]8;;", escaped, "\x07 end\n"))
        .when(d % 5 == 2, _s(escaped, "\n\x1b]open\x1b[0m\nrest\n\n\n\n"))
        .when(d % 5 == 3, line_end_text(d, text))
        .otherwise(_s(spread, "\x1b]0;a\nb\x07", _repeat("\nsame\x1b]\n\x07", d % 9), "\n"))).alias("text"))


def odd_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs without text or command, blank ones, JSON that breaks off, escapes that end nowhere, and lone line ends."""
    d, text = F.col("doc_id"), F.col("text")
    return text_table(spark, sf_dir, "documents", "doc_id", "text").select(
        d.alias("output_id"), F.lit(None).cast("string").alias("cmd"), (
            F.when(d % 8 == 0, F.lit(None).cast("string")).when(d % 8 == 1, "").when(d % 8 == 2, " \n\t\r\n")
            .when(d % 8 == 3, _s('{"a": null, "b": ', _json_string(text)))
            .when(d % 8 == 4, _s("\x1b[\x1b]0;", text, "\x1b\n\x1b(\n\n\n\n"))
            .when(d % 8 == 5, _s(_repeat("[", d % 50), text, _repeat("\n'\"", d % 30)))
            .when(d % 8 == 6, _s("\r\r\r\r", F.replace(text, F.lit(" "), F.lit("\n\r"))))
            .otherwise(_s("[null, ", _json_string(text), ", null] trailing"))).alias("text"))


def long_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs around the line limit, one per customer."""
    c = F.col("c_custkey")
    n = (400 + (c % 7) * 50).cast("int")
    return text_table(spark, sf_dir, "customer", "c_custkey", "c_name").select(
        c.alias("output_id"),
        F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _s(F.col("c_name"), " row ", i.cast("string"))),
                     "\n").alias("text"))


def wide_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs around the byte limit, one per supplier."""
    k = F.col("s_suppkey")
    width = (1500 + (k % 5) * 200).cast("int")
    return text_table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select(
        k.alias("output_id"),
        F.array_join(F.transform(
            F.sequence(F.lit(1), F.lit(300)),
            lambda i: _s(F.col("s_name"), " ", i.cast("string"), " ", F.repeat(F.lit("x"), width))),
            "\n").alias("text"))


# (tool name, command) by event_id % 20; the last has a blank command.
COMMANDS = [
    ("Bash", "git status"), ("bash", "/usr/bin/Cargo build"), ("execute_bash", "echo 'hello; world'"),
    ("Bash", "vim src/main.py"), ("Bash", "ls --watch"), ("Bash", "git fetch && git pull"),
    ("Bash", "test -f foo || echo missing"), ("Bash", "git log | head -20"), ("Bash", "echo $(date)"),
    ("Bash", "echo `date`"), ("Bash", "cat << EOF"), ("Bash", "echo a >> f"), ("Bash", "echo a > f"),
    ("Bash", "sort < f"), ("Bash", "make 2> f"), ("Bash", "make &> f"), ("Bash", "cd /tmp; ls"),
    ("Bash", "sleep 10 &"), ("Read", "a|b"), ("Bash", "  "),
]
# Two of the commands count as wrapped already, one as the tool itself.
WRAP_MARKER, OWN_NAMES = "/tmp", ("sort",)


def _command(event_id: Column) -> Column:
    k = (event_id % 20).cast("int")
    commands = F.array(*[F.lit(c) for _, c in COMMANDS])
    return _s(F.get(commands, k), F.when(k.isin(0, 1), _s(" ", event_id.cast("string"))).otherwise(""))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", _command(F.col("event_id")).alias("command"))


def tool_events_of(events: DataFrame) -> DataFrame:
    """Tool events as JSON text; every 97th is cut off in the middle."""
    e = F.col("event_id")
    names = F.array(*[F.lit(n) for n, _ in COMMANDS])
    value = F.to_json(F.struct(
        F.get(names, (e % 20).cast("int")).alias("tool_name"),
        F.struct(_command(e).alias("command")).alias("tool_input")))
    return events.select(
        "event_id", "ts", F.when(e % 97 == 0, F.substring(value, 1, 20)).otherwise(value).alias("value"))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_events_of(text_table(spark, sf_dir, "events", "event_id", "ts"))


def ref_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File reads and texts that mention files."""
    e, kind = F.col("event_id"), F.col("event_type")
    return text_table(spark, sf_dir, "events", "event_id", "user_id", "event_type").select(
        e.alias("output_id"), e.alias("seq"), F.lit("all").alias("scope"),
        F.when(kind == "view", _s("cat src/f", (F.col("user_id") % 10).cast("string"), ".py")).otherwise("cargo build")
        .alias("cmd"),
        _s("  --> src/f", (e % 12).cast("string"), ".py:3:1\nat src/f", (e % 7).cast("string"), ".py:10\n").alias("text"))


def compaction_log_of(documents: DataFrame) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars")
    return documents.select(
        F.timestamp_seconds(START + 3600 * d).alias("ts"), F.lit("all").alias("scope"),
        F.when(d % 3 == 0, "git").when(d % 3 == 1, "cargo").otherwise("ls").alias("cmd"),
        n.alias("original_tokens"), (n - F.expr("n_chars * (doc_id % 10) div 10")).alias("compressed_tokens"))


def compaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction_log_of(table(spark, sf_dir, "documents").select("doc_id", "n_chars"))
