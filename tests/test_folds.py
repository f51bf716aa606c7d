"""Folding rules: exact small cases, and both forms against sequential models."""

import random

import pytest
from pyspark.sql import functions as F
import models
from tersefold.functions.text import with_lines
from tersefold.operators import folds_doc, folds_lines

VOCAB = {
    "repeat": ["a\n", "b\n", "a \n", "\n", "x\r\n", "c\x0b", "d "],
    "diff": [" c1\n", "\tc2\n", "+add\n", "-del\n", " \n", "--- a\n", "\n"],
    "build": ["   Compiling x v1\n", "   Compiling y\n", "error: z\n", "  Compiling no\n"],
    "package": ["npm WARN x\n", "added 3 packages\n", "npm ERR! y\n", "found 0 things\n",
                "packages are ok\n", "package are\n", "added many\n"],
    "test": ["PASSED a\n", "tests/x.py ..\n", "collected 3\n", "  collected 1\n", "1 passed\n",
             "FAILED t\n", "ERROR t\n", "===== x\n", "_____ y\n", "short test summary\n", "\n",
             "platform linux\n", "rootdir: /\n", "E  assert\n", "has failed here\n", " \n"],
}
MODEL = {"repeat": models.repeats, **models.FAMILY}
LINE_FORM = {
    "repeat": folds_lines.collapse_repeats, "diff": folds_lines.fold_diff,
    "build": folds_lines.fold_build, "package": folds_lines.fold_package,
    "test": folds_lines.extract_test_failures,
}


def to_text(lines):
    parts = F.array_sort(F.collect_list(F.struct("pos", "part", "line")))
    return lines.groupBy("output_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("text"))


def random_docs(kind, n, seed, longest=24):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        lines, prev = [], None
        for _ in range(rng.randrange(0, longest)):
            prev = prev if prev and rng.random() < 0.6 else rng.choice(VOCAB[kind])
            lines.append(prev)
        if lines and rng.random() < 0.3:
            lines[-1] = lines[-1].rstrip("\n") or "end"
        docs.append((i, lines))
    return docs


def test_split_lines_as_python(spark):
    texts = ["", "a", "a\n", "\n", "a\r\nb\rc\n\rd", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h ",
             "\r\n\r\n", "é\n漢\n", "x\r", "a\x1fb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in with_lines(rows, "t", "x").collect()}
    assert got == {i: t.splitlines(keepends=True) for i, t in enumerate(texts)}


@pytest.mark.parametrize("kind", list(VOCAB))
def test_doc_form(spark, kind):
    docs = random_docs(kind, 600, seed=1)
    texts = ["".join(lines) for _, lines in docs]
    df = spark.createDataFrame([(i, t, kind) for i, t in enumerate(texts)], "i int, t string, f string")
    if kind == "repeat":
        df = folds_doc.collapse_repeats(df, "t", "o")
    else:
        df = folds_doc.fold_family(df, "t", "f", "o")
    got = {r.i: r.o for r in df.select("i", "o").collect()}
    want = {i: "".join(MODEL[kind](t.splitlines(keepends=True))) for i, t in enumerate(texts)}
    assert got == want


@pytest.mark.parametrize("block_rows", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("kind", list(VOCAB))
def test_line_form_any_block_size(spark, kind, block_rows):
    docs = [(i, "".join(ls).splitlines(keepends=True)) for i, ls in random_docs(kind, 150, seed=2)]
    rng = random.Random(3)
    rows = []
    for i, lines in docs:
        pos = 0
        for line in lines:
            rows.append((i, pos, line))
            pos += 1 if rng.random() < 0.7 else rng.randrange(2, 6)  # gaps in pos are allowed
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "output_id long, pos long, line string")
    out = to_text(LINE_FORM[kind](lines, block_rows=block_rows))
    got = {r.output_id: r.text for r in out.collect()}
    want = {i: "".join(MODEL[kind](ls)) for i, ls in docs if ls}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_one_output_holds_most_lines(spark):
    """A hot output spreads over blocks, and a run across many blocks stays one run."""
    rows = [(1, p, "same\n" if p < 5000 else f"l{p}\n") for p in range(6000)]
    rows += [(2, 0, "x\n")]
    lines = spark.createDataFrame(rows, "output_id long, pos long, line string")
    out = folds_lines.collapse_repeats(lines, block_rows=100).orderBy("output_id", "pos").collect()
    assert len(out) == 1 + 1000 + 1
    assert out[0].line == "same (×5000)\n"


def test_cuts(spark):
    n600 = "".join(f"l{i}\n" for i in range(600))
    crlf = "".join(f"l{i}\r\n" for i in range(501))
    wide = "".join(f"{i} " + "é" * 1000 + "\n" for i in range(300))
    one = "x" * 600_000
    few = "".join("y" * 3000 + "\n" for _ in range(200))
    df = spark.createDataFrame(list(enumerate([n600, crlf, wide, one, few, "s\n" * 500])), "i int, t string")
    got = {r.i: r.o for r in folds_doc.cut_lines(df, "t", "o").collect()}
    want = [f"l{i}" for i in range(600)]
    assert got[0] == "\n".join(want[:200] + ["[... 350 lines truncated]"] + want[-50:])
    want = [f"l{i}" for i in range(501)]
    assert got[1] == "\n".join(want[:200] + ["[... 251 lines truncated]"] + want[-50:])
    assert got[5] == "s\n" * 500
    got = {r.i: r.o for r in folds_doc.cut_bytes(df, "t", "o").collect()}
    ls = wide.splitlines(keepends=True)
    assert got[2] == "".join(ls[:200]) + "\n[... 50 lines truncated]\n" + "".join(ls[-50:])
    assert got[0] == n600 and got[3] == one and got[4] == few


def test_fold_plan_keeps_steps_apart(spark):
    """Arrays are built once per row: no split inside a lambda, no shuffle at all."""
    df = spark.createDataFrame([("a", "b")], "t string, f string")
    out = folds_doc.fold_family(folds_doc.collapse_repeats(df, "t", "o"), "o", "f", "p")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for line in plan.splitlines():
        assert "regexp_extract_all" not in line or "_starts" not in line.split("AS _lines")[0]
