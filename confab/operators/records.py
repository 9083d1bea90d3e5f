"""Nested session records and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.operators.sessionize import GAP_SECONDS, session_numbers

MESSAGE_FIELDS = ("t", "me", "from", "text")


def in_order(order: tuple[str, ...], fields: tuple[str, ...]) -> Column:
    """Aggregate: the group's rows as an array of ``fields`` structs in ``order``."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("m"))))
    return F.transform(packed, lambda x: x["m"])


def session_records(messages: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """chat_id, chat, group, start, end, messages: one row per session of cleaned message rows.

    chat and group depend on chat_id alone, so they ride in the grouping key. A session's messages meet in one
    array; what bounds it is the session, not the chat.
    """
    cut = session_numbers(messages, ["chat_id"], ["ord", "message_id"], "t", gap)
    nested = cut.groupBy("chat_id", "chat", "group", "session_no").agg(in_order(("ord", "message_id"), MESSAGE_FIELDS).alias("messages"))
    first, last = F.col("messages")[0]["t"], F.element_at("messages", -1)["t"]
    return nested.select("chat_id", "chat", "group", first.alias("start"), last.alias("end"), "messages")


def summary(flat: DataFrame, records: DataFrame) -> DataFrame:
    """n_chats (chats with a row before cleaning, even if no session is left), n_sessions, n_msgs."""
    none = F.lit(0).cast("bigint")
    chats = flat.agg(F.count_distinct("chat_id").alias("n_chats")).select("n_chats", none.alias("n_sessions"), none.alias("n_msgs"))
    done = records.select(none.alias("n_chats"), F.lit(1).cast("bigint").alias("n_sessions"), F.size("messages").cast("bigint").alias("n_msgs"))
    return chats.unionByName(done).agg(*[F.sum(c).alias(c) for c in ("n_chats", "n_sessions", "n_msgs")])
