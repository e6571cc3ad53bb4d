"""Conversations from their event logs, rendered with a loss mask, with DataFrame operations only.

A log has one row per event: ``conv_id``, ``message``, ``seq``, ``kind``, ``role``, ``text``. Events are folded message by message in the
order of ``seq``, so a long conversation is spread over tasks until its final messages are put in a row.

| kind | effect on its message |
|---|---|
| ``open`` | starts it with the role; a text, if any, is its beginning |
| ``delta`` | adds its text at the end |
| ``edit`` | its text replaces what was there |
| ``regenerate`` | clears the text; deltas that follow build it anew |
| ``remove`` | takes the message out, unless a later edit or regeneration brings it back |

Events of kinds not listed, or of none, are left out: they make no message, name no role and take no place. The template marks a turn with ``<|im_start|>`` and ``<|im_end|>``. Texts are escaped so that no
control string, of this template or of those in square brackets, can appear in them: ``&``, ``<`` and ``[`` become entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings and its entities, in the order of escaping.
START, END = "<|im_start|>", "<|im_end|>\n"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
NEWLINE = "&#10;"

RESETS = ("open", "edit", "regenerate", "remove")


def escape(text: Column) -> Column:
    for raw, entity in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    """A role stands on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log of finished turns (``conv_id, turn, role, text``): each is opened and then streamed in two deltas.

    A message is a row of the input, so repeated rows are repeated messages. Null texts and roles are empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.monotonically_increasing_id().alias("message"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"),
        half.alias("half"),
    )
    nothing = F.lit(None).cast("string")
    parts = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("open").alias("kind"), F.col("role").alias("role"), nothing.alias("text")),
        F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), nothing.alias("role"), F.substr("text", F.lit(1), F.col("half")).alias("text")),
        F.struct(F.lit(2).alias("step"), F.lit("delta").alias("kind"), nothing.alias("role"), F.substr("text", F.col("half") + 1).alias("text")),
    )
    return rows.select("conv_id", "message", "turn", F.explode(parts).alias("e")).select(
        "conv_id", "message", F.struct("turn", F.col("e.step").alias("step")).alias("seq"), "e.kind", "e.role", "e.text"
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, message, first_seq, role, text``. ``seq`` is anything that can be ordered; nulls come first.

    Events of equal ``seq`` are ordered by kind, role and text. A message that was never opened has the first role named, or an
    empty one. A null ``conv_id`` is a conversation like any other.
    """
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    kept = events.where(F.col("kind").isin(*RESETS, "delta"))
    folded = kept.groupBy("conv_id", "message").agg(log.alias("kept"))
    last = F.array_max(F.transform(folded["kept"], lambda e, i: F.when(e["kind"].isin(*RESETS), i).otherwise(-1)))
    roles = F.filter("kept", lambda e: e["role"].isNotNull())
    tail = F.slice("kept", F.greatest(F.col("last"), F.lit(0)) + 1, F.greatest(F.size("kept"), F.lit(1)))
    return (
        folded.withColumn("last", F.coalesce(last, F.lit(-1)))
        .where(F.coalesce(F.get(F.col("kept"), F.col("last"))["kind"] != "remove", F.lit(True)))
        .select(
            "conv_id",
            "message",
            F.get(F.col("kept"), F.lit(0))["seq"].alias("first_seq"),
            F.coalesce(F.get(roles, F.lit(0))["role"], F.lit("")).alias("role"),
            F.array_join(F.transform(F.filter(tail, lambda e: e["kind"] != "regenerate"), lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
        )
    )


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``mask``, the spans (start, length in characters) that carry the loss.

    Messages stand in the order of their first event; messages of equal place are ordered by role, text and key.
    """
    ready = messages.select(
        "conv_id",
        F.struct("first_seq", F.col("role").alias("r"), F.col("text").alias("t"), "message").alias("place"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == learned_role).alias("learned"),
    )
    turn = F.struct("place", "head", "body", "learned", F.char_length("head").alias("n_head"), F.char_length("body").alias("n_body"))
    rows = ready.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask"))

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + t["n_head"]
        span = F.array(F.struct(start.alias("start"), t["n_body"].cast("long").alias("length")))
        return F.struct(
            (start + t["n_body"] + len(END)).alias("at"),
            F.when(t["learned"], F.concat(state["mask"], span)).otherwise(state["mask"]).alias("mask"),
        )

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return rows.select("conv_id", text.alias("formatted"), F.aggregate("turns", nothing, add, lambda s: s["mask"]).alias("mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """What a reader finds in the output: ``turns`` (role, text) and ``learned``, the texts under the mask, with the escapes undone."""
    parts = F.slice(F.split("formatted", r"\Q" + START + r"\E"), 2, F.greatest(F.size(F.split("formatted", r"\Q" + START + r"\E")) - 1, F.lit(1)))
    body = lambda p: F.substr(p, F.char_length(F.substring_index(p, "\n", 1)) + 2)
    turns = F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(body(p), F.lit(1), F.char_length(body(p)) - len(END))).alias("text"),
        ),
    )
    learned = F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return rendered.select("conv_id", "formatted", "mask", turns.alias("turns"), learned.alias("learned"))


def digests(read: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of each conversation."""
    loss = F.array_join("learned", "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
