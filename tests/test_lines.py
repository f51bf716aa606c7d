"""Line tables: all line ends from files, escapes and JSON over lines and blocks."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tersefold.functions.text import with_lines
from tersefold.operators import folds_lines
from tersefold.operators.escapes import after_lf, cut_anew, split_notes, strip_over_lines, stripped_pieces
from tersefold.operators.runs import BLOCK
from tersefold.plans.compact import compact_text
from tersefold.plans.compact_lines import compact_lines
from tersefold.session import collected, stage_buckets
from tersefold.sources import lines as lines_module
from tersefold.sources.lines import read_lines

ENDS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]


def line_table(spark, texts):
    outputs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "output_id long, text string")
    lines = with_lines(outputs, "text", "lines").select("output_id", F.posexplode("lines").alias("pos", "line"))
    return outputs, lines.withColumn("pos", F.col("pos").cast("long"))


def joined(lines):
    got = {}
    for r in lines.orderBy("output_id", "pos").collect():
        got.setdefault(r.output_id, []).append(r.line)
    return got


@pytest.mark.parametrize("split", [1, 3, 7, 1 << 20])
def test_files_are_cut_at_every_line_end_wherever_ranges_end(spark, tmp_path, monkeypatch, split):
    rng = random.Random(split)
    texts = ["", "x", "\r\n", "\r", "\n\r", "\r\r\n\n", "é ż\x85漢 ", "no end at all", "  ", "a\r\n" * 30]
    texts += ["".join(rng.choice([*ENDS, "a", "żó", "€", "w" * 9]) for _ in range(rng.randint(1, 60))) for _ in range(split + 4)][:30]
    monkeypatch.setattr(lines_module, "MAX_TASKS", 8)
    for k, t in enumerate(texts):
        (tmp_path / f"{k:03d}.log").write_bytes(t.encode())
    got = {}
    for r in read_lines(spark, str(tmp_path), split).orderBy("path", "pos").collect():
        rows = got.setdefault(int(re.search(r"(\d+)\.log", r.path)[1]), [])
        assert r.pos == len(rows)
        rows.append(r.line)
    assert got == {k: t.splitlines(keepends=True) for k, t in enumerate(texts) if t}


def test_ranges_are_moved_and_no_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ab\ncd\r\n" * 500)
    (tmp_path / "b.txt").write_bytes(b"x" * 300 + b"\ny")
    read = read_lines(spark, str(tmp_path), 100).select(F.col("path").endswith("a.txt").alias("a"), "pos", "line")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert not any(step in above for step in ("Window", "Join", "Repartition"))
    got = sorted((r.a, r.pos, r.line) for r in read.collect())
    assert got == [(False, 0, "x" * 300 + "\n"), (False, 1, "y")] + [(True, i, ("ab\n", "cd\r\n")[i % 2]) for i in range(1000)]


def test_lines_longer_than_ranges_and_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"x" * 3_000_000 + b"\r" + b"y" * 2_500_000 + b"\n\xff\xfe\n")
    got = [r.line for r in read_lines(spark, str(tmp_path), 100_000).orderBy("pos").collect()]
    assert [len(x) for x in got] == [3_000_001, 2_500_001, 3] and got[2] == "��\n"
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "empty.log").write_bytes(b"")
    assert read_lines(spark, str(tmp_path / "b")).count() == 0


ANSI = re.compile("\x1b\\[[0-9;]*[mGKHF]|\x1b\\][^\x07]*\x07|\x1b[()][AB012]")


@pytest.mark.parametrize("block", [1, 5])
def test_escapes_over_lines_equal_the_whole_text(spark, block):
    rng = random.Random(block)
    pieces = ["\x1b]", "\x07", "\x1b[0m", "\x1b(B", "\x1b", "]", "t", "uv ", "\n", "\n", "\r\n", "\r", " ", "\x1b]0;t\n\x07"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(150)]
    texts += ["a\x1b]x\n" + "hidden\n" * 30 + "\x07b\n", "a\r\x1b[0m\n", "\x1b]\n" * 20, "a\x1b]\n\x07" * 20 + "z", "plain\n\ntext"]
    _, lines = line_table(spark, texts)
    some = lines.filter(F.col("line").contains("\x1b")).select("output_id").distinct()
    got = joined(strip_over_lines(lines, some, block))
    want = {k: ANSI.sub("", t).splitlines(keepends=True) for k, t in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v}


def test_lines_behind_lf(spark):
    texts = ["\n\n", "a\r\n\nb", "\x0b\n\n", "x\n\ny\r\n"]
    _, lines = line_table(spark, texts)
    for block in (1, 3, 100):
        got = sorted((r.output_id, r.pos, r.after_lf) for r in after_lf(lines, block).collect())
        want = [(k, i, i > 0 and t.splitlines(keepends=True)[i - 1].endswith("\n"))
                for k, t in enumerate(texts) for i in range(len(t.splitlines()))]
        assert got == want


@pytest.mark.parametrize("block", [5])
def test_line_form_equals_text_form_over_lines_and_line_ends(spark, block):
    rng = random.Random(block)
    pieces = [f"{w}{e}" for w in ("x", "", "", " c", "PASSED t", "FAILED t", "added 1", "a\x1b]0;", "b\x07", "\x1b[1mg\x1b[0m") for e in ENDS[:5]]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 50))) + rng.choice(["", "end"]) for _ in range(120)]
    numbers = ",\n".join(f"  {{\"n\": {i}, \"gone\": null, \"s\": \"a\\u00e9\"}}" for i in range(60))
    texts += [f"\n \n[\n{numbers}\n]\n\n", f'{{\r\n"a": null,\r\n"rows": [{numbers}]\r\n}}', "{\n\"a\": 1\n}", "{\n\"a\": \n1 ", "[1,\n2]\nx",
              "[\n" + ",\n".join(["null"] * 600) + "\n]\n", "\x1b[32m{\n\"k\"\n: null,\n\n\n\n\"l\": [1,\n null ]}\x1b[0m\n"]
    texts += ["\r\r\r\r" + "a\r\n" * 5 + "b\x0b" * 9 + "\r" * 600, "start\rPASSED a\n\nx\rPASSED b\n\n\n\nFAILED z\n\n\n"]
    commands = [rng.choice(["git", "cargo", "pytest", "npm", "ls"]) for _ in range(120)] + ["curl"] * 8 + ["pytest"]
    outputs, lines = line_table(spark, texts)
    named = spark.createDataFrame(list(enumerate(commands)), "output_id long, cmd string")
    got = {k: "".join(v) for k, v in joined(compact_lines(lines, named, block_rows=block)).items()}
    want = {r.output_id: r.result for r in compact_text(outputs.join(named, "output_id")).collect() if r.result}
    assert sorted(got) == sorted(want)
    assert [k for k in got if got[k] != want[k]] == []
    assert got[120].count("\n") == 1 and "gone" not in got[121]


def test_steps_leave_lines_in_their_blocks(spark):
    """No step on a bucketed table moves lines: what is shuffled has no column of texts."""
    _, lines = line_table(spark, ["a\x1b[0m\n" * 9 + " c\n" * 9 + "\n" * 9, "x"])
    table = stage_buckets([lines.withColumn("_block", F.expr("pos div 4")).repartition(8, *BLOCK)], BLOCK, "lines")
    steps = [folds_lines.fold_diff, folds_lines.fold_build, folds_lines.fold_package, folds_lines.extract_test_failures,
             lambda df, n: split_notes(folds_lines.collapse_repeats(df, n)), after_lf, stripped_pieces, lambda df, n: cut_anew(df, n)[0]]
    for step in steps:
        df = step(table, 4)
        assert "_block" in df.columns
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION" not in plan and "Bucketed: true" in plan
        moved = re.findall(r"Exchange[^\n]*\n[ :]*\+- (.*)", plan)
        assert not any(re.search(r"\bline#\d+L?\b(?![^\[]*\()", m.split("functions=")[0]) for m in moved)


def test_tables_of_steps_are_gone(spark):
    _, lines = line_table(spark, ["\x1b]0;a\nb\x07\r\n\nx\n" * 9, " \n", '{\n"a": null\n,\n"b": null}', "PASSED a\r\n\nz\r" * 4])
    commands = spark.createDataFrame([(0, "git"), (2, "ls"), (3, "pytest")], "output_id long, cmd string")
    with collected() as staged:
        done = compact_lines(lines, commands, 3)
    left = {re.match(r"[a-z]+", os.path.basename(p))[0] for p in staged if os.path.exists(p)}
    assert left == {"facts", "blank", "stripped", "repeats", "sizes", "shrinks"} and done.count() > 0
    assert {r.tableName for r in spark.sql("SHOW TABLES").collect()} == set()
