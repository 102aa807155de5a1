"""The conversation log: an index of conversations and their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import local_time
from tidemark.operators.positions import with_position
from tidemark.tables import materialise

INDEX = "id string, created_at string"
MESSAGES = "id bigint, ref_id string, chat_id string, role string, message string"
#: chat_id of the rows that set a conversation up.
SYSTEM_ROW = "system-init"
#: Messages of one part of a transcript.
PART = 500


def append_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the conversations of `new` (id, epoch) that it doesn't hold yet; a repeated id is kept once."""
    fresh = new.groupBy("id").agg(F.min("epoch").alias("epoch")).join(index.select("id"), "id", "left_anti")
    return index.unionByName(fresh.select("id", local_time(F.col("epoch")).alias("created_at")))


def append_messages(messages: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """The log with the rows of `new` (ref_id, chat_id, role, message) after it, numbered on in the given order."""
    last = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    return messages.unionByName(with_position(new, *order, name="id", start=last + 1).select(*messages.columns))


def load_messages(messages: DataFrame, ref_id: str | None = None) -> DataFrame:
    """ref_id and messages (array of role and content, in the order of writing) of one conversation or of all."""
    rows = messages if ref_id is None else messages.where(F.col("ref_id") == ref_id)
    ordered = F.array_sort(F.collect_list(F.struct("id", "role", F.col("message").alias("content"))))
    return rows.groupBy("ref_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def transcript_parts(messages: DataFrame, size: int = PART) -> DataFrame:
    """ref_id, part, first_id, transcript: conversations of any length in parts of `size` messages, numbered from 0.

    The log is range-partitioned and sorted by conversation and id once, and every message has its place in it: a range
    begins where the ranges before it end, so a conversation that goes over many of them is never one task's. Its first
    place is a minimum by conversation that meets the messages again, split by Spark where one has most of them. No row
    holds more than `size` messages. Joined in the order of their numbers, by line breaks, the parts are the transcript.
    NULL messages are left out of it, messages without a conversation are one of their own; ties keep the order of reading.
    """
    placed = with_position(messages.select("ref_id", "id", "role", "message"), "ref_id", "id")
    firsts = materialise(placed.groupBy("ref_id").agg(F.min("position").alias("__first")).withColumnRenamed("ref_id", "__ref"), "conversation_firsts")
    place = (F.col("position") - F.col("__first")).alias("place")
    rows = placed.join(firsts, F.col("ref_id").eqNullSafe(F.col("__ref"))).select("ref_id", "id", place, F.concat("role", F.lit(": "), "message").alias("line"))
    parts = rows.groupBy("ref_id", F.floor(F.col("place") / size).alias("part")).agg(F.min("id").alias("first_id"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return parts.select("ref_id", "part", "first_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("transcript"))


def transcript(loaded: DataFrame) -> DataFrame:
    """Loaded conversations as text, a line `role: content` for each message."""
    return loaded.select("ref_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("transcript"))


def orphans(messages: DataFrame, index: DataFrame) -> DataFrame:
    """Messages whose conversation isn't in the index."""
    return messages.join(index.select(F.col("id").alias("ref_id")), "ref_id", "left_anti")
