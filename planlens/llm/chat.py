"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log of events (conv_id, seq, message, kind, role, text) is folded into final messages and rendered with one template.
Kinds: ``message`` starts a message with a text, ``delta`` appends to it, ``edit`` replaces what it says, ``regenerate``
discards what it says so that later deltas build it anew; other kinds are ignored. Messages are ordered by ``message``,
events by ``seq``; of events with one seq, those that start afresh come first.

Folding groups by (conv_id, message), so a conversation with very many deltas is spread out and each message is
combined before a conversation is put together. A rendered conversation is one row, as its digest needs it whole.

Template: ``### role: text</turn>`` and a line end for each turn. In a text a backslash is doubled, ``### `` becomes ``\\h`` and
``</turn>`` becomes ``\\t``; in a role ``:`` also becomes ``\\c``. So no text can forge a mark, and ``parse`` reads back exactly
what went in. The loss mask is the list of spans of the assistant texts, marks excluded.

Defined cases: null texts and roles are empty; repeated rows stay separate turns in the order of role and text; a null
conv_id is a conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
STARTS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit(OPEN), F.lit("\\h")), F.lit(CLOSE), F.lit("\\t"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: doubled backslashes are split off first, left to right, so that the rest is unambiguous."""
    part = F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit(OPEN)), F.lit("\\t"), F.lit(CLOSE)), F.lit("\\c"), F.lit(":")))
    return F.array_join(part, "\\")


def events(turns: DataFrame) -> DataFrame:
    """The event log of a table of turns (conv_id, turn, role, text): each turn starts empty and is streamed as one delta."""
    again = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.struct("turn", again.alias("again")))
    log = F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), F.lit("").alias("said")), F.struct(F.lit(1).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.col("text").alias("said")))
    return rows.select("conv_id", "message", "role", F.explode(log).alias("e")).select("conv_id", "e.seq", "message", "e.kind", "role", F.col("e.said").alias("text"))


def messages(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text: what every message says in the end."""
    starts = F.col("kind").isin(*STARTS)
    log = log.where(starts | (F.col("kind") == "delta"))
    event = F.struct("seq", F.when(starts, 0).otherwise(1).alias("late"), F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    folded = log.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(event)).alias("events"),
        F.max(F.when(starts, F.col("seq"))).alias("start"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
    )
    # of several starts with one seq, the last in order counts: all before it go
    live = F.filter("events", lambda e: F.col("start").isNull() | (e["seq"] >= F.col("start")))
    at = F.coalesce(F.array_max(F.transform(live, lambda e, i: F.when((e["late"] == 0) & (e["seq"] == F.col("start")), i))), F.lit(0))
    said = F.array_join(F.transform(F.slice(live, at + 1, F.size(live)), lambda e: e["text"]), "")
    return folded.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), said.alias("text"))


def render(final: DataFrame) -> DataFrame:
    """conv_id, formatted and mask: the rendered text and the spans (code points, end exclusive) of assistant texts in it."""
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c"))
    head = F.concat(F.lit(OPEN), role, F.lit(": "))
    piece = F.concat(head, escape(F.col("text")), F.lit(CLOSE + "\n"))
    rows = final.select("conv_id", "message", "role", head.alias("head"), piece.alias("piece"))
    end = F.sum(F.length("piece")).over(Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end - len(CLOSE) - 1).withColumn("start", F.col("end") - F.length("piece") + F.length("head") + len(CLOSE) + 1)
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "role", "piece", "start", "end"))).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return packed.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), mask.alias("mask"))


def parse(formatted: Column) -> Column:
    """An array of (role, text) read back from a rendered conversation."""
    pieces = F.split(formatted, CLOSE + "\n", -1)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda x: F.struct(unescape(F.substr(F.substring_index(x, ": ", 1), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(x, F.length(F.substring_index(x, ": ", 1)) + 3)).alias("text")),
    )


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
