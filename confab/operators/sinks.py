"""JSON Lines output."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_jsonl(records: DataFrame, path: str, single_file: bool = False) -> None:
    """Overwrites ``path`` with one object per line, null fields kept. Spark commits the new files only when all are written.

    ``single_file`` orders by chat and start into one part: for small exports, as one task writes it.
    """
    if single_file:
        records = records.repartition(1).sortWithinPartitions("chat_id", "start")
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
