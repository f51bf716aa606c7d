"""Which lines each folding rule takes and what it writes; shared by doc and line form."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed


def _any(conditions) -> Column:
    return reduce(or_, conditions)


def repeat_key(line: Column) -> Column:
    """The line without its closing LF; other line ends are part of it."""
    return F.when(line.endswith("\n"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def repeat_note(line: Column, n: Column) -> Column:
    return F.concat(repeat_key(line), F.lit(" (×"), n.cast("string"), F.lit(")\n"))


def context_line(line: Column) -> Column:
    return line.startswith(" ") | line.startswith("\t")


def context_note(n: Column) -> Column:
    return F.concat(F.lit("  ... ("), (n - 2).cast("string"), F.lit(" unchanged lines)\n"))


def build_line(line: Column) -> Column:
    return line.startswith(fixed.BUILD_PREFIX)


def build_note(n: Column) -> Column:
    return F.concat(F.lit(fixed.BUILD_PREFIX + "... ("), n.cast("string"), F.lit(" crates)\n"))


def package_line(line: Column) -> Column:
    return line.rlike(fixed.PACKAGE_LINE)


def package_note(n: Column) -> Column:
    return F.concat(F.lit("[npm: "), n.cast("string"), F.lit(" info lines omitted]\n"))


def test_marker(line: Column) -> Column:
    return _any(line.startswith(m) for m in fixed.TEST_MARKERS)


def test_kept(line: Column, failing: Column) -> Column:
    """Whether a line that is no marker stays; `failing`: a marker came before it."""
    telling = _any(
        [line.rlike(rf"\A{fixed.WS}*+(?:{fixed.TEST_KEEP_START}|\z)")]
        + [line.contains(w) for w in fixed.TEST_KEEP_CONTAINS]
        + [line.startswith(w) for w in fixed.TEST_KEEP_PREFIX])
    return ~line.startswith(fixed.TEST_PASSED) & (failing | telling)


def passed_note(n: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit(" passed]\n"))


def omitted_note(n: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit(" lines omitted]\n"))
