"""Conversations rebuilt from event logs and rendered with a reversible template and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import table

# Template: "### " role ": " text "</turn>\n". Escaped texts hold neither "###" nor "</turn>".
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
# Escapes, the backslash itself first; the last is for roles only.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPE = (COLON, "\\c")
STARTS = ("message", "edit", "regenerate")
LOSS_ROLE = "assistant"
TEST_CONV, TEST_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: Column, *more: tuple[str, str]) -> Column:
    for plain, code in (*ESCAPES, *more):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Split at escaped backslashes first: what is between holds single escapes only."""
    def part(p: Column) -> Column:
        for plain, code in (*ESCAPES[1:], ROLE_ESCAPE):
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg_id, seq, role, text) of an event log.

    Events are (conv_id, msg_id, seq, kind, role, text). `message` opens a
    message, `delta` appends to it, `edit` puts another text in its place and
    `regenerate` throws its text away for the deltas to come (its own text, if
    any, is the beginning). Per message the last of the opening kinds counts,
    with the deltas behind it, in the order of seq; at equal seq opening kinds
    come first, then by text. Position and role are those of the first event
    that names a role. Null text is empty, null seq comes first, unknown and
    null kinds append like `delta`. A message is folded by itself, so a long
    conversation is spread over tasks.
    """
    starts = F.coalesce(F.col("kind").isin(*STARTS), F.lit(False))
    event = F.struct(
        F.col("seq"), (~starts).alias("later"), F.coalesce("text", F.lit("")).alias("text"), "role")
    folded = events.groupBy("conv_id", "msg_id").agg(F.sort_array(F.collect_list(event)).alias("_log"))

    def text(log: Column) -> Column:
        last = F.array_max(F.transform(log, lambda e, i: F.when(~e["later"], i)))
        return let(last, lambda at: F.array_join(F.transform(F.filter(
            log, lambda e, i: i >= F.coalesce(at, F.lit(0))), lambda e: e["text"]), ""))

    named = F.get(F.filter("_log", lambda e: e["role"].isNotNull()), F.lit(0))
    return folded.select(
        "conv_id", "msg_id", F.get("_log", F.lit(0))["seq"].alias("seq"), named["role"].alias("role"),
        text(F.col("_log")).alias("text"))


def render(messages: DataFrame, template_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, `formatted` and `segments` (text, loss) of each conversation.

    Messages in the order of seq, then role and text; a null role is written
    empty. The segments joined are `formatted`; `loss` marks the text of
    assistant messages and nothing else. A conversation is one string, so its
    messages meet in one row; an empty table gives no rows.
    """
    role = F.coalesce("role", F.lit(""))
    message = F.struct("seq", role.alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    whole = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("_messages"))

    def pieces(m: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(m["role"], ROLE_ESCAPE), F.lit(COLON))
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in (
            (head, F.lit(False)), (m["text"], m["role"] == template_role), (F.lit(CLOSE), F.lit(False)))])

    segments = F.flatten(F.transform("_messages", pieces))
    return whole.select("conv_id", segments.alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a rendered conversation."""
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")

    def turn(t: Column) -> Column:
        body = F.substring(t, F.lit(len(OPEN) + 1), F.length(t))
        return let(F.instr(body, COLON), lambda at: F.struct(
            unescape(F.substring(body, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(body, at + len(COLON), F.length(body))).alias("text")))

    return F.transform(turns, turn)


def turn_events(turns: DataFrame) -> DataFrame:
    """A table of turns as the log that made it, one message per row, repeated rows too.

    Assistant texts come as a draft that is regenerated, then as two deltas;
    other texts are opened empty and edited.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.expr("cast(length(coalesce(text, '')) div 2 as int)")
    left, right = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    event = lambda step, kind, text: F.struct(
        F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(event(0, "message", F.lit("")), event(1, "delta", left), event(2, "regenerate", F.lit("")),
                       event(3, "delta", left), event(4, "delta", right))
    edited = F.array(event(0, "message", left), event(1, "edit", text))
    # Numbered in a step of its own: beside explode() the events would be numbered.
    numbered = turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("msg_id"))
    return numbered.select(
        "conv_id", "msg_id", "turn", "role",
        F.explode(F.when(F.col("role") == LOSS_ROLE, streamed).otherwise(edited)).alias("_e")).select(
        "conv_id", "msg_id", F.struct("turn", F.col("_e.step").alias("step")).alias("seq"), F.col("_e.kind"),
        "role", F.col("_e.text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(TEST_CONV).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(TEST_TEXT).alias("text"))
    done = render(fold_events(turn_events(turns.unionByName(extra))))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss.alias("loss")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
