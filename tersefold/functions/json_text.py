"""Null removal and minification of JSON text, written as regular expressions.

The text is never given a schema and never re-serialised as a whole: numbers
keep their spelling and keys their order. A string token is matched with
possessive quantifiers only, so long strings need no regex stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# Raw control characters are not allowed inside a JSON string.
STRICT_STRING = r'"[^"\\\x00-\x1f]*+(?:\\[^\x00-\x1f][^"\\\x00-\x1f]*+)*+"'

# Half of a surrogate pair: no character, so the escape has to stay.
LONE_SURROGATE = (
    r"\\u[dD][89aAbB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])"
    r"|(?<!\\u[dD][89aAbB][0-9a-fA-F]{2})\\u[dD][c-fC-F]"
)


def is_json(text: Column) -> Column:
    """Strict check of one complete document; text must start with { or [.

    The document is put into an array in front of a sentinel. The sentinel is
    found only if the document ended where it should, and being a hash of the
    text it cannot be part of it. What the JVM parser allows beyond the
    standard, single quotes and raw control characters, is caught by looking
    at what remains when all proper strings are taken out.
    """
    def complete(mark: Column) -> Column:
        probe = F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))
        return F.coalesce(F.get_json_object(probe, "$[1]") == mark, F.lit(False))

    rest = F.regexp_replace(text, STRICT_STRING, "")
    return let(F.md5(text), complete) & ~rest.rlike("[\"']")


def drop_nulls_and_space(text: Column) -> Column:
    """For valid JSON: no white space, null members or null elements outside strings."""
    def drop(out: Column) -> Column:
        for pattern in (rf"{STRING}:null(?:,|(?=\}}))|({STRING})", rf"(?<=[\[,])null(?:,|(?=\]))|({STRING})",
                        rf"({STRING})|,(?=[}}\]])"):
            out = F.regexp_replace(out, pattern, "$1")
        return out

    return let(F.regexp_replace(text, rf"({STRING})|\s++", "$1"),
               lambda out: F.when(out.contains("null"), drop(out)).otherwise(out))


def _decode(token: Column) -> Column:
    """One string token with its \\uXXXX and \\/ escapes replaced by the characters."""
    value = F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")
    plain = F.to_json(F.array(value))
    plain = F.substring(plain, F.lit(2), F.length(plain) - 2)
    return F.when(value.isNull() | token.rlike(LONE_SURROGATE), token).otherwise(plain)


def _lower_control_escapes(text: Column) -> Column:
    """Control characters stay escaped; their hex digits become lower case."""
    out = text
    for upper in "ABCDEF":
        out = F.regexp_replace(out, rf"((?<!\\)(?:\\\\)*+\\u00[01]){upper}", f"$1{upper.lower()}")
    return out


def decode_escapes(df: DataFrame, text: str) -> DataFrame:
    """Replace \\uXXXX and \\/ escapes in the JSON column of that name by their characters."""
    body = F.col(text)
    tokens = F.regexp_extract_all(body, F.lit(rf'({STRING}|[^"]++)'), F.lit(1))
    decoded = F.array_join(
        F.transform(tokens, lambda t: F.when(t.rlike(r"\A\"(?s).*\\[u/]"), _decode(t)).otherwise(t)), "")
    df = df.withColumn(text, F.when(body.rlike(r"\\[u/]"), decoded).otherwise(body))
    return df.withColumn(text, F.when(body.contains("\\u00"), _lower_control_escapes(body)).otherwise(body))
