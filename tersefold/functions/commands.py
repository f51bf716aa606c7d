"""Column expressions over command strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import strip


def base_command(cmd: Column) -> Column:
    """First word of a command without its directories, lower case; '' for a blank command."""
    first = F.regexp_extract(cmd, rf"\A{fixed.WS}*({fixed.NWS}+)", 1)
    return F.lower(F.regexp_replace(first, r"(?s)\A.*[/\\]", ""))


def family(base_cmd: Column) -> Column:
    out = None
    for name, commands in fixed.FAMILY_COMMANDS.items():
        hit = base_cmd.isin(commands)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(fixed.OTHER_FAMILY)


def has_bare_semicolon(cmd: Column) -> Column:
    """A semicolon outside quotes; a quote left open runs to the end."""
    quoted = r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)"""
    return F.regexp_replace(cmd, quoted, "").contains(";")


def skip_reason(command: Column, wrap_marker: str | None = None,
                own_names: Sequence[str] = ()) -> Column:
    """Why the output of a command must not be compacted; null if it may be.

    The rules are tried in this order and the first hit decides.
    """
    cmd = strip(command)
    base = base_command(cmd)
    rules: list[tuple[Column, str]] = []
    if wrap_marker:
        rules.append((cmd.contains(wrap_marker), "already-compressed"))
    if own_names:
        rules.append((base.isin(list(own_names)), "self"))
    rules.append((base.isin(fixed.INTERACTIVE), "interactive"))
    rules += [(cmd.contains(flag), "watch-mode") for flag in fixed.WATCH_FLAGS]
    rules += [(cmd.contains(op), f"shell-op:{op.strip()}") for op in fixed.SHELL_OPS]
    rules += [(cmd.contains(op), f"redirect:{op.strip()}") for op in fixed.REDIRECTS]
    rules.append((cmd.contains(";") & has_bare_semicolon(cmd), "shell-op:;"))
    rules.append((cmd.endswith(" &") | cmd.contains(" & "), "background-job"))
    (first, label), *rest = rules
    out = F.when(first, label)
    for hit, label in rest:
        out = out.when(hit, label)
    return out


def read_path(cmd: Column) -> Column:
    """Path that a file-reading command puts into view, or null.

    The last word counts if there is more than one and its last path part has
    a suffix: a dot that is neither first nor last in that part. Closing "/"
    and "/." do not count as parts.
    """
    words = F.filter(F.split(cmd, f"{fixed.WS}+"), lambda w: w != "")
    reader = F.lower(F.regexp_replace(F.get(words, F.lit(0)), r"(?s)\A.*/", ""))
    last = F.get(words, F.size(words) - 1)
    has_suffix = last.rlike(r"(?:\A|/)[^/]+\.[^/.]+(?:/\.?)*+\z")
    found = reader.isin(fixed.FILE_READERS) & (F.size(words) > 1) & has_suffix
    return F.when(cmd.contains(".") & F.lower(cmd).rlike("|".join(fixed.FILE_READERS)), F.when(found, last))
