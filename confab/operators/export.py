"""The whole job in one call: flat archive rows to session files and run counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.operators.records import session_records
from confab.operators.sessionize import GAP_SECONDS
from confab.operators.sinks import write_jsonl


def write_sessions(flat: DataFrame, clean: Callable[[DataFrame], DataFrame], path: str, gap: int = GAP_SECONDS, single_file: bool = False) -> tuple[int, int, int]:
    """Writes the sessions of ``flat`` as JSON Lines to ``path`` and returns (n_chats, n_sessions, n_msgs).

    Chats count before cleaning, even if no session is left of them. Sessions and messages are counted in what was written, so
    that they aren't computed twice.
    """
    records = session_records(clean(flat), gap)
    write_jsonl(records, path, single_file)
    written = flat.sparkSession.read.schema(records.schema).json(path)
    done = written.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("messages")).first()
    return flat.agg(F.count_distinct("chat_id")).first()[0], done["sessions"], done["messages"]
