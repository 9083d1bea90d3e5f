"""``python -m confab apple|whatsapp DATABASE OUT [CHAT]``: an archive's sessions as JSON Lines, and one line of counts."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from confab.functions import to_jid
from confab.operators import GAP_SECONDS, clean_apple, clean_whatsapp, write_sessions
from confab.session import get_session
from confab.sources import apple_messages, apple_tables, register, whatsapp_messages, whatsapp_tables


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs the job; returns the line that it prints. A chat of the second archive may be a phone number."""
    parser = argparse.ArgumentParser(prog="confab")
    parser.add_argument("archive", choices=("apple", "whatsapp"))
    parser.add_argument("database")
    parser.add_argument("out")
    parser.add_argument("chat", nargs="?")
    parser.add_argument("--gap", type=int, default=GAP_SECONDS, help="seconds of silence that end a session")
    given = parser.parse_args(args)
    spark = spark or get_session()
    register(spark)
    if given.archive == "apple":
        flat, clean = apple_messages(apple_tables(spark, given.database), given.chat), clean_apple
    else:
        chat = None if given.chat is None else spark.range(1).select(to_jid(F.lit(given.chat))).first()[0]
        flat, clean = whatsapp_messages(whatsapp_tables(spark, given.database), chat), clean_whatsapp
    chats, sessions, messages = write_sessions(flat, clean, given.out, given.gap, single_file=True)
    said = f"{messages} messages in {sessions} sessions of {chats} chats -> {given.out}"
    print(said)
    return said


if __name__ == "__main__":
    main()
