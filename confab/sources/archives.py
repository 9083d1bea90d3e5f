"""Adapters that bring two message archives to one flat row.

Flat row: chat_id, chat, is_group, message_id, ord (raw date, for order), t (Unix seconds), is_from_me, sender, text,
attributed_body (null where the archive has none). Dates count from 2001-01-01 in both archives, in nanoseconds in one
and in fractional seconds in the other. The Column expressions ``apple_epoch_ns``/``apple_epoch_s`` shift them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the archive formats.
APPLE_EPOCH = 978307200
NS = 1_000_000_000
GROUP_STYLE = 43
PLAIN_MESSAGE = 0
TEXT_TYPES = (0, 7)

APPLE_SCHEMAS = {
    "message": "ROWID bigint, date bigint, is_from_me int, handle_id bigint, text string, attributedBody binary, associated_message_type int",
    "chat_message_join": "chat_id bigint, message_id bigint",
    "chat": "ROWID bigint, chat_identifier string, style int",
    "handle": "ROWID bigint, id string",
}
WHATSAPP_SCHEMAS = {
    "ZWAMESSAGE": "Z_PK bigint, ZCHATSESSION bigint, ZMESSAGEDATE double, ZISFROMME int, ZFROMJID string, ZGROUPMEMBER bigint, ZTEXT string, ZMESSAGETYPE int",
    "ZWACHATSESSION": "Z_PK bigint, ZCONTACTJID string, ZSESSIONTYPE int",
    "ZWAGROUPMEMBER": "Z_PK bigint, ZMEMBERJID string",
}


def apple_epoch_ns(date: Column) -> Column:
    """Nanoseconds since 2001 to Unix seconds, truncated toward zero before the shift."""
    return F.call_function("div", date, F.lit(NS).cast("bigint")) + F.lit(APPLE_EPOCH)


def apple_epoch_s(date: Column) -> Column:
    """Fractional seconds since 2001 to Unix seconds; a value outside bigint becomes null."""
    return date.try_cast("bigint") + F.lit(APPLE_EPOCH)


def _load(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    reader = spark.read.format("sqlite_ro").option("path", path)
    return {name: reader.schema(schema).option("table", name).load() for name, schema in schemas.items()}


def apple_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return _load(spark, path, APPLE_SCHEMAS)


def whatsapp_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return _load(spark, path, WHATSAPP_SCHEMAS)


def _only(chats: DataFrame, column: str, chat: str | None) -> DataFrame:
    """``chat`` null: every chat. An empty string is a filter that no chat passes unless its name is empty."""
    return chats if chat is None else chats.filter(F.col(column) == chat)


def apple_messages(tables: dict[str, DataFrame], chat: str | None = None) -> DataFrame:
    """Messages that aren't reactions, once per chat they belong to; a missing handle leaves the sender null.

    The joins carry no hints: the chat and handle tables broadcast while the optimizer's size statistics allow it.
    """
    m, bridge = tables["message"].alias("m"), tables["chat_message_join"].alias("b")
    c = _only(tables["chat"], "chat_identifier", chat).alias("c")
    joined = (
        m.filter(F.col("m.associated_message_type") == PLAIN_MESSAGE)
        .join(bridge, F.col("b.message_id") == F.col("m.ROWID"))
        .join(c, F.col("c.ROWID") == F.col("b.chat_id"))
        .join(tables["handle"].alias("h"), F.col("h.ROWID") == F.col("m.handle_id"), "left")
    )
    return joined.select(
        F.col("c.ROWID").alias("chat_id"),
        F.col("c.chat_identifier").alias("chat"),
        F.coalesce(F.col("c.style") == GROUP_STYLE, F.lit(False)).alias("is_group"),
        F.col("m.ROWID").alias("message_id"),
        F.col("m.date").alias("ord"),
        apple_epoch_ns(F.col("m.date")).alias("t"),
        F.col("m.is_from_me").alias("is_from_me"),
        F.col("h.id").alias("sender"),
        F.col("m.text").alias("text"),
        F.col("m.attributedBody").alias("attributed_body"),
    )


def whatsapp_messages(tables: dict[str, DataFrame], chat: str | None = None) -> DataFrame:
    """Messages of the text types; in groups the member row names the sender. An unknown session type counts as a group."""
    m, s = tables["ZWAMESSAGE"].alias("m"), _only(tables["ZWACHATSESSION"], "ZCONTACTJID", chat).alias("s")
    joined = (
        m.filter(F.col("m.ZMESSAGETYPE").isin(*TEXT_TYPES))
        .join(s, F.col("s.Z_PK") == F.col("m.ZCHATSESSION"))
        .join(tables["ZWAGROUPMEMBER"].alias("g"), F.col("g.Z_PK") == F.col("m.ZGROUPMEMBER"), "left")
    )
    return joined.select(
        F.col("s.Z_PK").alias("chat_id"),
        F.col("s.ZCONTACTJID").alias("chat"),
        (~F.col("s.ZSESSIONTYPE").eqNullSafe(F.lit(0))).alias("is_group"),
        F.col("m.Z_PK").alias("message_id"),
        F.col("m.ZMESSAGEDATE").alias("ord"),
        apple_epoch_s(F.col("m.ZMESSAGEDATE")).alias("t"),
        F.col("m.ZISFROMME").alias("is_from_me"),
        F.coalesce(F.col("g.ZMEMBERJID"), F.col("m.ZFROMJID")).alias("sender"),
        F.col("m.ZTEXT").alias("text"),
        F.lit(None).cast("binary").alias("attributed_body"),
    )
