"""Chat logs to formatted conversations.

A log is a table of events: ``message`` opens a message, ``delta`` appends streamed text to it, ``edit`` puts
a new text in its place, ``regenerate`` starts its text anew. Events are folded by message in order
of their sequence number, messages of a conversation stand in order of their first event, and
each is rendered by a template that marks turns and keeps their text from looking like marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm.arrays import let

OPEN, OPENED, CLOSE = "<turn ", ">\n", "\n</turn>\n"
#: Signs of the template and what stands for them inside roles and texts; undone in reverse order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


#: Code points of a block in which masked places are looked up.
BLOCK = 4096


def escaped(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def messages(events: DataFrame) -> DataFrame:
    """One row a message: conv_id, message_id, seq (of its first event), role, text.

    ``events`` has conv_id, message_id, seq, op, role, text. The text is what the last ``message``, ``edit`` or
    ``regenerate`` event gave and every later ``delta``; the role is the first that is not null, else empty. Null texts
    are empty; null seqs come first; events with one seq go by op (``delta`` last) and text; an unknown op is a
    ``delta``; deltas before any other event open the message.
    """
    delta = ~F.coalesce(F.col("op").isin("message", "edit", "regenerate"), F.lit(False))
    event = F.struct("seq", delta.alias("delta"), "op", F.coalesce("text", F.lit("")).alias("text"), "role")
    logged = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("log"))
    reset = F.array_max(F.transform("log", lambda x, i: F.when(~x["delta"], i)))
    live = F.slice("log", F.coalesce(reset, F.lit(0)) + 1, F.size("log"))
    return logged.select(
        "conv_id",
        "message_id",
        F.col("log")[0]["seq"].alias("seq"),
        F.coalesce(F.get(F.filter("log", lambda x: x["role"].isNotNull()), F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"),
    )


def rendered(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_mask (array of start, length in code points of formatted).

    Null conv_ids are one conversation, equal turns each count, an empty table gives an empty result. ``turns`` has conv_id, seq, role, text (not null); those with one seq go by role and text. Each turn is rendered in its own
    row; only rendered turns are gathered. The mask covers the texts of role ``learn``, without marks.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(OPENED))
    body = escaped(F.col("text"))
    own = turns.select("conv_id", "seq", "role", "text", head.alias("head"), body.alias("body"))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    size = F.char_length("head") + F.char_length("body") + F.lit(len(CLOSE))
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.select("conv_id", F.row_number().over(order).alias("place"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"), (before + F.char_length("head")).cast("bigint").alias("start"), F.char_length("body").cast("bigint").alias("length"), (F.col("role") == learn).alias("learnt"))
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "learnt", "start", "length"))).alias("all"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["turn"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x["learnt"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text."""
    turns = F.split(formatted, CLOSE)
    turns = F.slice(turns, 1, F.size(turns) - 1)  # after the last mark nothing is left
    cut = lambda x: F.instr(x, OPENED)
    return F.transform(turns, lambda x: F.struct(unescaped(F.substring(x, F.lit(len(OPEN) + 1), cut(x) - len(OPEN) - 1)).alias("role"), unescaped(F.substring(x, cut(x) + len(OPENED), F.char_length(x))).alias("text")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The texts of ``formatted`` at the places (start, length) of ``mask``, unescaped, one after the other.

    The string is cut into blocks once and a place is looked up in its own blocks, so long conversations are not read again for every turn.
    """
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(of: Column, x: Column) -> Column:
        first, last = F.floor(x["start"] / BLOCK).cast("int"), F.floor((x["start"] + x["length"]) / BLOCK).cast("int")
        own = F.array_join(F.slice(of, first + 1, last - first + 1), "")
        return unescaped(F.substring(own, (x["start"] - first * BLOCK + 1).cast("int"), x["length"].cast("int")))

    return let(blocks, lambda of: F.array_join(F.transform(mask, lambda x: cut(of, x)), ""))


def format_chats(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Events to formatted conversations: conv_id, formatted, loss_mask.

    Rows with a null conv_id are one conversation; null texts and roles are empty; equal events each count; ties of seq go as ``messages``
    and ``rendered`` say; an empty table gives an empty result; other columns are ignored, whatever their names. One conversation
    is one value, so its rendered turns meet in one row, however many or long they are; events are folded and rendered
    before that, spread over message ids.
    """
    return rendered(messages(events.select("conv_id", "message_id", "seq", "op", "role", "text")), learn)


def chat_report(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """For each conversation of (conv_id, turn, role, text) rows, read back from its formatted text: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Each row is a ``message`` event of its own, which is folded, rendered and read again; the loss columns are of the text that the loss mask
    covers. Null conv_ids are one conversation; null turns come first; rows of one turn go by role and text, equal ones each count;
    null texts and roles are empty; an empty table gives an empty result; other columns are ignored. A very long conversation is one value.
    """
    events = conversations.select("conv_id", F.monotonically_increasing_id().alias("message_id"), F.col("turn").alias("seq"), F.lit("message").alias("op"), "role", "text")
    chats = format_chats(events, learn).withColumn("turns", read_back(F.col("formatted")))
    chats = chats.withColumn("learnt", under_mask(F.col("formatted"), F.col("loss_mask")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
