"""Chat transcripts from an event log, rendered with a template that can be read back.

The log holds events of messages: ``start`` opens one, ``delta`` adds text to
it, ``edit`` puts a text in the place of what there is, ``regenerate`` drops it.
Folding keeps what follows the last edit or regeneration of each message and
joins it in the order of the log; conversations then list their messages in the
order of their first events.

A turn is rendered as ``### role ###``, a line break, the text, ``</turn>`` and a line
break. In roles and texts a backslash, ``#`` and the slash of ``</turn>`` are preceded by
a backslash, so neither mark can occur inside. The loss mask covers the text of
every assistant turn between those marks.

Only built-in functions are used. Long conversations are joined in blocks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

EVENTS = ("start", "delta", "edit", "regenerate")
# Log positions that a block of a conversation spans.
BLOCK = 512
_HEAD, _MIDDLE, _END = "### ", " ###\n", "</turn>\n"


def escape(text: Column) -> Column:
    """Text in which no mark of the template occurs."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the final messages of (conv_id, message, seq, kind, role, text).

    ``at`` is a message's first position. Events of one message in one position
    are taken by kind and text; null texts are empty, null positions come first,
    a null kind is a delta. The role is that of the first event that has one,
    else empty.
    """
    seq = F.coalesce("seq", F.lit(-(1 << 62)))
    kind = F.coalesce("kind", F.lit("delta"))
    known = events.select("conv_id", "message", seq.alias("seq"), kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    resets = F.col("kind").isin("edit", "regenerate")
    # An edit sets the text, so it counts as a reset and then as text.
    rank = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    state = known.groupBy("conv_id", "message").agg(
        F.min("seq").alias("at"), F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.max(F.when(resets, F.struct("seq", rank.alias("rank")))).alias("reset"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != "regenerate", F.struct("seq", rank.alias("rank"), "text")))).alias("parts"))
    # Of edits in one place the last by text stands.
    after = F.filter("parts", lambda p: F.col("reset").isNull() | (F.struct(p["seq"], p["rank"]) >= F.col("reset")))
    edits = F.size(F.filter(after, lambda p: (p["rank"] == 2) & (p["seq"] == F.col("reset")["seq"])))
    final = F.when(edits > 1, F.slice(after, edits, F.greatest(F.size(after), F.lit(1)))).otherwise(after)
    text = F.array_join(F.transform(final, lambda p: p["text"]), "")
    return state.select("conv_id", "at", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted) of (conv_id, at, role, text): messages by position, ties by role and text."""
    turn = F.concat(F.lit(_HEAD), escape(F.col("role")), F.lit(_MIDDLE), escape(F.col("text")), F.lit(_END))
    turns = messages.select("conv_id", F.floor(F.col("at") / BLOCK).alias("block"), F.struct("at", "role", "text", turn.alias("turn")).alias("m"))

    def joined(column: str, field: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x[field]), "")

    blocks = turns.groupBy("conv_id", "block").agg(joined("m", "turn").alias("formatted"))
    whole = blocks.select("conv_id", F.struct("block", "formatted").alias("b"))
    return whole.groupBy("conv_id").agg(joined("b", "formatted").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): turns as structs of role and text, still escaped."""
    # Behind the last end mark stands nothing.
    pieces = F.filter(F.split("formatted", _END, -1), lambda p: p != "")

    def parse(piece: Column) -> Column:
        middle = F.instr(piece, F.lit(_MIDDLE))
        return F.struct(
            F.substring(piece, F.lit(len(_HEAD) + 1), middle - F.lit(len(_HEAD) + 1)).alias("role"),
            F.substring(piece, middle + F.lit(len(_MIDDLE)), F.length(piece)).alias("text"))

    return formatted.select("conv_id", "formatted", F.transform(pieces, parse).alias("turns"))


def loss_text(turns: str) -> Column:
    """All text under the loss mask, unescaped."""
    assistant = F.filter(turns, lambda t: t["role"] == "assistant")
    return unescape(F.array_join(F.transform(assistant, lambda t: t["text"]), ""))


def events_of(conversations: DataFrame) -> DataFrame:
    """A log for finished turns (conv_id, turn, role, text): each row is a message that starts and gets its text.

    Repeated rows are turns of their own.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("message"))
    start = F.struct(F.lit("start").alias("kind"), "role", F.lit(None).cast("string").alias("text"))
    delta = F.struct(F.lit("delta").alias("kind"), "role", "text")
    return rows.select("conv_id", "message", F.col("turn").alias("seq"), F.explode(F.array(start, delta)).alias("e")).select(
        "conv_id", "message", "seq", "e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the marks themselves, written and read back."""
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = read_back(stored(render(fold(events_of(rows))), "formatted"))
    line = F.lit("\n")
    whole = unescape(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), ""))
    return turns.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        loss_text("turns").alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
