"""Multi-party chats: every participant's perspective, with masks [DataFrame functions].

For each participant of a conversation its dialogue is rendered with that speaker as the assistant, all others as named
users, and system messages as they are. The mask spans cover what the assistant says, with its end mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_rank, written

SYSTEM = "system"
UNNAMED = "unknown"
END = "<|end|>"
#: Turns in a part of a rendered dialogue: longer ones go on in the next part, so that no task holds a whole long one.
PART_TURNS = 1024


def perspectives(messages: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, speaker, part, n_messages, text, spans, target_chars.

    One row for each participant (a role other than ``system``) and part of a conversation. ``spans`` lists
    ``start:end`` in code points, after which ``text[start:end]`` is a target. Order: turn, then role and text for equal or
    null turns, nulls last (in part -1). Where a part by turn numbers would hold more than ``part_turns`` messages, that
    conversation is cut by the ranks of its messages instead, so that no part of any conversation holds more. A null role is ``unknown``, a null text is empty, null conv_ids are one
    conversation. Marks inside texts and names are defused. Repeated rows are repeated messages. A conversation of system
    messages alone has no perspective. A text of any length is rendered whole, once for each participant. An empty table gives no rows; other columns are not read.
    """
    clean = F.regexp_replace(F.coalesce(F.col("role"), F.lit(UNNAMED)), r"[<>|:\r\n]", "_")
    body = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |"))
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")
    m = messages.select(
        "conv_id", part.alias("part"), F.col("turn").isNull().alias("late"), F.col("turn").cast("long").alias("turn"), clean.alias("role"), body.alias("body")
    )
    m = _bounded(m, part_turns)
    speakers = m.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    parts = m.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("late", "turn", "role", "body"))).alias("said"))
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
    mine = lambda x: x["role"] == F.col("speaker")
    head = lambda x: (
        F.when(mine(x), F.lit("<|assistant|>\n")).when(x["role"] == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), x["role"], F.lit("|>\n")))
    )
    pieces = F.transform("said", lambda x: F.struct(head(x).alias("head"), F.concat(x["body"], F.lit(END)).alias("tail"), mine(x).alias("mine")))
    seen = seen.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("target"), F.array().cast("array<string>").alias("spans"))

    def add(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["tail"])
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct(
            (end + 1).alias("at"),
            (acc["target"] + F.when(p["mine"], end - begin).otherwise(F.lit(0))).alias("target"),
            F.when(p["mine"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    seen = seen.withColumn("mask", F.aggregate("pieces", start, add))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["tail"], F.lit("\n"))), "")
    return seen.select(
        "conv_id", "speaker", "part", F.size("pieces").cast("long").alias("n_messages"), text.alias("text"),
        F.array_join("mask.spans", ",").alias("spans"), F.col("mask.target").alias("target_chars"),
    )


def _bounded(m: DataFrame, part_turns: int) -> DataFrame:
    """The messages, conversations with an overfull part cut anew by rank: ``part_turns`` messages a part."""
    full = m.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_turns)
    full = written(full.select(F.col("conv_id").alias("_full")).distinct(), "overfull")
    if full.isEmpty():
        return m
    over = F.col("conv_id").eqNullSafe(F.col("_full"))
    ranked = with_rank(m.join(full, over, "left_semi"), [F.col(c) for c in ("conv_id", "late", "turn", "role", "body")], "rank")
    ranked = written(ranked, "ranked-messages")
    first = ranked.groupBy("conv_id").agg(F.min("rank").alias("_first")).withColumnRenamed("conv_id", "_full")
    cut = ranked.join(first, over).withColumn("part", F.floor((F.col("rank") - F.col("_first")) / part_turns).cast("long"))
    return m.join(full, over, "left_anti").unionByName(cut.select(m.columns))
