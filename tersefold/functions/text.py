"""Column expressions over one text value. Nothing here shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(text: Column) -> Column:
    """Empty or white space only."""
    return text.rlike(rf"\A{fixed.WS}*\z")


def strip(text: Column) -> Column:
    """Both ends trimmed of white space, in Python's sense of it."""
    return F.btrim(text, F.lit(fixed.WS_TEXT))


def strip_ansi(text: Column) -> Column:
    return F.when(text.contains(fixed.ESC), F.regexp_replace(text, fixed.ANSI, "")).otherwise(text)


def with_secret(df: DataFrame, text: str, out: str = "is_secret") -> DataFrame:
    """Add whether the text holds something that looks like a secret."""
    df = df.withColumn("_lower", F.lower(text))
    hints = [f"contains(_lower, {_literal(h)})" for h in fixed.SECRET_HINTS]
    hints += [f"contains({text}, {_literal(h)})" for h in fixed.SECRET_HINTS[-3:]]
    found = F.when(F.expr(" OR ".join(hints)), F.col(text).rlike(fixed.SECRET)).otherwise(F.lit(False))
    return df.withColumn(out, found).drop("_lower")


def collapse_blank_lines(text: Column) -> Column:
    return F.when(text.contains("\n\n\n"), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text)


def token_estimate(n_chars: Column) -> Column:
    """Tokens for a text of n_chars code points: four to a token, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor((n_chars + 3) / 4))


def reduction_pct(original: Column, compressed: Column, digits: int = 0) -> Column:
    """Saved share in percent, ties to even; 0 when there was nothing to save from."""
    pct = F.bround((original - compressed) / original * 100, digits)
    return F.when(original > 0, pct).otherwise(F.lit(0.0))


def other_line_ends(text: str) -> Column:
    """The text in the column of that name has line ends besides LF."""
    return F.expr(" OR ".join(
        f"contains({text}, {_literal(e)})" for e in fixed.LINE_ENDS if e != "\n"))


def with_lines(df: DataFrame, text: str, out: str, wanted: Column | None = None,
               mixed: str | None = None) -> DataFrame:
    """Add the array of lines, terminators kept; null where `wanted` is false.

    The empty text has no lines. Texts with LF ends only, the usual case, take
    the plain split; `mixed` may name a column that says which texts cannot.
    The steps are separate columns: an array used twice in one expression would
    be built again for every element.
    """
    body = F.col(text)
    wanted = F.lit(True) if wanted is None else wanted
    if mixed is None:
        df = df.withColumn("_ends", other_line_ends(text))
        mixed = "_ends"
    df = df.withColumns({
        "_plain": F.when(wanted & ~F.col(mixed), F.split(body, "\n", -1)),
        "_other": F.when(wanted & F.col(mixed), F.regexp_extract_all(body, F.lit(fixed.LINE), F.lit(0))),
    })
    df = df.withColumns({"_pieces": F.expr("size(_plain)"), "_closed": F.expr("element_at(_plain, -1) = ''")})
    # All pieces but the last were followed by LF; an empty last piece is no line.
    lines = F.expr("""transform(slice(_plain, 1, _pieces - int(_closed)),
                      (x, i) -> if(i < _pieces - 1, concat(x, '\\n'), x))""")
    return df.withColumn(out, F.coalesce("_other", lines)).drop(
        "_ends", "_plain", "_other", "_pieces", "_closed")


def without_line_end(line: Column) -> Column:
    return F.regexp_replace(line, rf"(?:\r\n|{fixed.LINE_END})\z", "")


def may_exceed_lines(text: str, n: int, mixed: str) -> Column:
    """True for every text of more than n lines, and for few others; no split needed."""
    return F.expr(f"length({text}) > {n} AND ({mixed} OR length({text}) - length(replace({text}, '\\n', '')) >= {n})")


def _literal(text: str) -> str:
    """SQL string literal; characters outside printable ASCII as escapes."""
    return "'" + "".join(c if " " <= c <= "~" else f"\\u{ord(c):04x}" for c in text) + "'"
