"""Chat formatting from an event log.

The log has ``conv_id, turn, tie, seq, kind, role, text``. An event belongs to the message
(conv_id, turn, tie). ``start`` opens it with a role; ``delta`` appends; ``edit`` replaces what there
is; ``regenerate`` empties it. Folding sorts a message's events by ``seq`` and joins the texts
from the last edit or regeneration on. Messages are folded on their own, then rendered in blocks
of turns, then blocks are joined per conversation, so that the last step handles few rows even
for a conversation that holds a large share of the log. Built-in functions only.

Rendered turns are ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string inside a text gets a
backslash after its first character, one more than it may already have there, which ``unescape``
takes away again; other texts are not touched. The loss mask is a list of pieces with a flag.

NULL texts and roles are empty. Repeated turns of a conversation are all kept, ordered by role
and text. Rows with a NULL conversation or turn form a conversation or turn of their own, first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template, and strings that common templates treat as control.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"
PIECE = 256
BLOCK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", r"$1$2$3")


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("%5B", "["), ("%3C", "<"), ("%0A", "\n"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def event_log(conversations: DataFrame) -> DataFrame:
    """The log of a chat server that has streamed these turns.

    Every text comes in deltas of at most ``PIECE`` characters. An assistant's first delta is streamed,
    thrown away by a regeneration and streamed anew; other roles send their last delta only and
    then edit the message to the whole text, which tests all kinds on every conversation.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tie", F.row_number().over(order))
    count = F.ceil(F.length("text") / PIECE).cast("int")
    starts = F.when(count == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), count - 1))
    pieces = F.transform(starts, lambda n: F.substring(F.col("text"), n * PIECE + 1, F.lit(PIECE)))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    deltas = F.transform(pieces, lambda p: event("delta", p))
    first = F.array(event("start", F.lit("")))
    again = F.concat(first, F.slice(deltas, 1, 1), F.array(event("regenerate", F.lit(""))), deltas)
    edited = F.concat(first, F.slice(deltas, F.greatest(count, F.lit(1)), F.lit(1)), F.array(event("edit", F.col("text"))))
    events = F.when(F.col("role") == "assistant", again).otherwise(edited)
    return turns.select("conv_id", "turn", "tie", "role", F.posexplode(events).alias("seq", "e")).select(
        "conv_id", "turn", "tie", F.col("seq").cast("long").alias("seq"), "e.kind", "role", "e.text"
    )


def fold(log: DataFrame) -> DataFrame:
    """``conv_id, turn, tie, role, text``: the messages that the events leave."""
    event = F.struct("seq", "kind", "text")
    by = log.groupBy("conv_id", "turn", "tie").agg(
        F.max("role").alias("role"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("reset"),
        F.sort_array(F.collect_list(event)).alias("events"),
    )
    counted = F.filter(
        "events", lambda e: e["kind"].isin("delta", "edit") & (e["seq"] >= F.coalesce(F.col("reset"), F.lit(-1)))
    )
    return by.select("conv_id", "turn", "tie", "role", F.concat_ws("", F.transform(counted, lambda e: e["text"])).alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, pieces``: array of (text, loss); the formatted conversation is their concatenation."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.array(
        piece(F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")), F.lit(False)),
        piece(escape(F.col("text")), F.col("role") == loss_role),
        piece(F.lit(CLOSE + "\n"), F.lit(False)),
    )
    turn = F.struct("turn", "tie", pieces.alias("pieces"))
    flat = lambda parts: F.flatten(F.transform(F.sort_array(F.collect_list(parts)), lambda t: t["pieces"]))
    blocks = messages.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(flat(turn).alias("pieces"))
    return blocks.groupBy("conv_id").agg(flat(F.struct("block", "pieces")).alias("pieces"))


def formatted(pieces: Column) -> Column:
    return F.concat_ws("", F.transform(pieces, lambda p: p["text"]))


def read_turns(text: Column) -> Column:
    """Array of (role, text) parsed from a formatted conversation."""
    chunks = F.filter(F.split(text, r"<\|im_start\|>"), lambda c: c != "")

    def turn(c: Column) -> Column:
        cut = F.locate("\n", c)
        return F.struct(
            unescape_role(F.substring(c, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(c, cut + 1, F.length(c) - cut - len(CLOSE) - 1)).alias("text"),
        )

    return F.transform(chunks, turn)
