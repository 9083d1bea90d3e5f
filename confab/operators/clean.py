"""Flat rows to message rows: chat_id, chat, group, message_id, ord, t, me, from, text.

Cleaning comes before sessions are cut, so that a dropped row never bridges a gap. Rows without a time can't be placed
and are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions.text import message_body, own_or_sender, strip_unicode, without_placeholder


def _shape(flat: DataFrame, text: Column, me: Column) -> DataFrame:
    return flat.select(
        "chat_id",
        "chat",
        F.col("is_group").alias("group"),
        "message_id",
        "ord",
        "t",
        me.alias("me"),
        own_or_sender(me, F.col("sender")).alias("from"),
        text.alias("text"),
    ).filter((F.col("text") != "") & F.col("t").isNotNull())


def _is_me() -> Column:
    return F.coalesce(F.col("is_from_me"), F.lit(0)) != 0


def clean_apple(flat: DataFrame) -> DataFrame:
    """Drops system events (not mine, no sender) and bodies that are empty once placeholders and white space are gone."""
    event = ~_is_me() & (F.col("sender").isNull() | (F.col("sender") == ""))
    body = message_body(F.col("text"), F.col("attributed_body"))
    return _shape(flat.filter(~event), strip_unicode(without_placeholder(body)), _is_me())


def clean_whatsapp(flat: DataFrame) -> DataFrame:
    """Drops empty bodies; an incoming message without a sender stays."""
    return _shape(flat, strip_unicode(F.coalesce(F.col("text"), F.lit(""))), _is_me())
