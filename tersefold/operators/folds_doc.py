"""Line folding inside one text column ("doc form"): linear, no shuffle.

Each step is its own select, so that the optimizer keeps them apart and no
array is built again for every element of a lambda. Texts that cannot hold
anything to fold are found by one pattern and never split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.json_text import decode_escapes, drop_nulls_and_space, is_json
from ..functions.text import may_exceed_lines, other_line_ends, strip, with_lines, without_line_end
from .line_rules import (
    build_line, build_note, context_line, context_note, omitted_note,
    package_line, package_note, passed_note, repeat_key, repeat_note,
    test_marker, test_kept,
)

# Both are matched against the text with LF put around it.
_LONG_CONTEXT = r"\n(?:[ \t][^\n]*+\n){3}[ \t]"
_THREE_EQUAL = r"\n([^\n]*+)\n\1\n\1\n"


def _between_lf(text: str) -> Column:
    return F.expr(f"concat('\\n', {text}, '\\n')")


def _with_mixed(df: DataFrame, text: str, mixed: str | None) -> tuple[DataFrame, str]:
    """The column that marks texts with line ends besides LF, added if there is none."""
    return (df, mixed) if mixed else (df.withColumn("_ends", other_line_ends(text)), "_ends")


def _fold_runs(df: DataFrame, text: str, out: str, wanted: Column, mixed: str,
               key: Callable[[Column], Column],
               render: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """Fold runs of lines with equal non-null key.

    render(lines, start, n, total) gives the text of the run of n lines from
    start. Texts outside `wanted` pass unchanged.
    """
    df = with_lines(df, text, "_lines", wanted, mixed)
    df = df.withColumns({"_keys": F.transform("_lines", key), "_total": F.expr("size(_lines)")})
    df = df.withColumn("_starts", F.expr("""if(_lines IS NULL, NULL, filter(
        sequence(0, greatest(_total - 1, 0)),
        i -> i = 0 OR NOT coalesce(get(_keys, i) = get(_keys, i - 1), false)))"""))
    df = df.withColumn("_runs", F.expr("""transform(_starts, (a, p) -> named_struct(
        'a', a, 'n', coalesce(get(_starts, p + 1), _total) - a))"""))
    folded = F.array_join(
        F.transform("_runs", lambda r: render(F.col("_lines"), r["a"], r["n"], F.col("_total"))), "")
    return df.withColumn(out, F.coalesce(folded, F.col(text))).drop(
        "_ends", "_lines", "_keys", "_total", "_starts", "_runs")


def _slice_text(lines: Column, start: Column, n: Column) -> Column:
    return F.when(n == 1, F.get(lines, start)).otherwise(
        F.array_join(F.slice(lines, start + 1, n), ""))


def collapse_repeats(df: DataFrame, text: str, out: str, mixed: str | None = None) -> DataFrame:
    """Three or more equal lines in a row become one line with a count."""
    df, mixed = _with_mixed(df, text, mixed)
    wanted = F.col(mixed) | _between_lf(text).rlike(_THREE_EQUAL)

    def render(lines, start, n, total):
        return F.when(n >= 3, repeat_note(F.get(lines, start), n)).otherwise(
            _slice_text(lines, start, n))

    return _fold_runs(df, text, out, wanted, mixed, repeat_key, render)


def fold_family(df: DataFrame, text: str, family: str, out: str, mixed: str | None = None) -> DataFrame:
    """Apply the line folding of each text's command family; other families pass."""
    df, mixed = _with_mixed(df, text, mixed)
    fam = F.col(family)
    wanted = F.expr(f"""CASE {family}
        WHEN 'build' THEN contains({text}, '{fixed.BUILD_PREFIX}')
        WHEN 'package' THEN contains({text}, 'npm WARN') OR contains({text}, 'added ')
            OR contains({text}, 'package') OR contains({text}, 'found ')
        WHEN 'test' THEN true ELSE false END""")
    wanted = F.when(fam == "diff", F.col(mixed) | _between_lf(text).rlike(_LONG_CONTEXT)).otherwise(wanted)

    def key(line):
        return (
            F.when(fam == "diff", F.when(context_line(line), 1))
            .when(fam == "build", F.when(build_line(line), 1))
            .when(fam == "package", F.when(package_line(line), 1))
            .otherwise(F.when(~test_marker(line), 1))
        )

    def render(lines, start, n, total):
        first = F.get(lines, start)
        whole = _slice_text(lines, start, n)
        last = F.get(lines, start + n - 1)
        # A stretch without markers behind the first line follows a failure.
        kept = F.filter(F.slice(lines, start + 1, n), lambda x: test_kept(x, start > 0))
        dropped = n - F.size(kept)
        counter = F.when(dropped == 0, "").when(
            start + n == total, omitted_note(dropped)).otherwise(passed_note(dropped))
        return (
            F.when(fam == "diff", F.when(
                context_line(first) & (n > 3), F.concat(first, context_note(n), last)).otherwise(whole))
            .when(fam == "build", F.when(build_line(first), build_note(n)).otherwise(whole))
            .when(fam == "package", F.when(package_line(first), package_note(n)).otherwise(whole))
            .otherwise(F.when(test_marker(first), whole).otherwise(
                F.concat(F.array_join(kept, ""), counter)))
        )

    return _fold_runs(df, text, out, wanted, mixed, key, render)


def cut_lines(df: DataFrame, text: str, out: str, mixed: str | None = None) -> DataFrame:
    """Texts over the line limit keep head and tail; line ends become LF, none at the end."""
    df, mixed = _with_mixed(df, text, mixed)
    df = with_lines(df, text, "_lines", may_exceed_lines(text, fixed.MAX_LINES, mixed), mixed)
    df = df.withColumn("_n", F.expr("size(_lines)"))
    kept = F.concat(F.slice("_lines", 1, fixed.KEEP_HEAD), F.array(_cut_note(F.col("_n"))),
                    F.slice("_lines", -fixed.KEEP_TAIL, fixed.KEEP_TAIL))
    cut = F.array_join(F.transform(kept, without_line_end), "\n")
    return df.withColumn(out, F.when(F.col("_n") > fixed.MAX_LINES, cut).otherwise(F.col(text))).drop(
        "_ends", "_lines", "_n")


def cut_bytes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Texts over the byte limit keep head and tail lines; too few lines to cut: unchanged."""
    df = with_lines(df, text, "_lines", F.octet_length(text) > fixed.MAX_BYTES)
    df = df.withColumn("_n", F.expr("size(_lines)"))
    kept = F.concat(F.slice("_lines", 1, fixed.KEEP_HEAD),
                    F.array(F.concat(F.lit("\n"), _cut_note(F.col("_n")), F.lit("\n"))),
                    F.slice("_lines", -fixed.KEEP_TAIL, fixed.KEEP_TAIL))
    return df.withColumn(
        out, F.when(F.col("_n") > fixed.KEEP_HEAD + fixed.KEEP_TAIL, F.array_join(kept, ""))
        .otherwise(F.col(text))).drop("_lines", "_n")


def _cut_note(n: Column) -> Column:
    return F.concat(F.lit("[... "), (n - fixed.KEEP_HEAD - fixed.KEEP_TAIL).cast("string"),
                    F.lit(" lines truncated]"))


def minify_json(df: DataFrame, text: str, out: str, wanted: Column | None = None) -> DataFrame:
    """JSON documents lose nulls and white space if that saves more than a tenth."""
    candidate = F.col(text).rlike(rf"\A{fixed.WS}*+[\[{{]")
    if wanted is not None:
        candidate = wanted & candidate
    df = df.withColumn("_body", F.when(candidate, strip(F.col(text))))
    df = df.withColumn("_json", F.when(is_json(F.col("_body")), F.col("_body")))
    df = decode_escapes(df.withColumn("_min", drop_nulls_and_space(F.col("_json"))), "_min")
    smaller = F.expr("length(_min) * 10 < length(_body) * 9")
    return df.withColumn(out, F.when(smaller, F.concat("_min", F.lit("\n"))).otherwise(F.col(text))).drop(
        "_body", "_json", "_min")
