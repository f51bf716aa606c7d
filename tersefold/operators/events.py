"""Tool events to commands, and why a command's output must stay as it is."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.commands import base_command, skip_reason
from ..functions.json_text import is_json
from ..functions.text import is_blank

EVENT = "struct<tool_name:string,tool_input:struct<command:string>>"


def parse_events(events: DataFrame, value: str = "value") -> DataFrame:
    """Add tool_name, command and reject_reason; rejected events stay in the table."""
    raw = F.col(value)
    # A column of its own, so that every event is parsed once.
    parsed = events.withColumn("_event", F.from_json(raw, EVENT)).withColumns({
        "tool_name": F.col("_event.tool_name"), "command": F.col("_event.tool_input.command")})
    # from_json turns any value into text, so the command's own type is looked at; null is dealt with below.
    given = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), "$.tool_input.command", "variant"))
    braces = raw.rlike(r"\A\s*\{")
    reject = (
        F.when(F.when(braces, ~is_json(raw)).otherwise(F.try_parse_json(raw).isNull()), "invalid-json")
        .when(~braces, "not-an-object")
        .when(~F.coalesce(F.lower("tool_name").isin(fixed.SHELL_TOOLS), F.lit(False)), "other-tool")
        .when(~F.coalesce(given.isin("STRING", "VOID"), F.lit(True)), "not-a-string")
        .when(F.coalesce(is_blank(F.col("command")), F.lit(True)), "no-command")
    )
    return parsed.withColumn("reject_reason", reject).drop("_event")


def classify(commands: DataFrame, wrap_marker: str | None = None,
             own_names: Sequence[str] = ()) -> DataFrame:
    """Add base_cmd and skip_reason; a null reason means the output may be compacted."""
    return commands.select(
        "*", base_command(F.col("command")).alias("base_cmd"),
        skip_reason(F.col("command"), wrap_marker, own_names).alias("skip_reason"))


def skip_report(classified: DataFrame) -> DataFrame:
    return (
        classified.groupBy(F.coalesce("skip_reason", F.lit("eligible")).alias("skip_reason"))
        .agg(F.count(F.lit(1)).alias("commands"))
    )
