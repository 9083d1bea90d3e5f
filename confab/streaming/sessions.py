"""Streaming counterpart of ``operators.sessionize``: lag isn't allowed on streams, session windows are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.operators.sessionize import GAP_SECONDS


def stream_sessions(rows: DataFrame, keys: list[str], t: str = "t", gap: int = GAP_SECONDS, watermark: str | None = None) -> DataFrame:
    """keys, start, end, n per session; works on batch and streaming input alike.

    Times are whole seconds, and rows without one are dropped. ``session_window`` also merges at exactly ``gap``. Its
    own end is last + gap, so ``end`` comes from the rows. ``watermark`` bounds the state of a stream.
    """
    timed = rows.withColumn("_ts", F.timestamp_seconds(F.col(t)))
    if watermark:
        timed = timed.withWatermark("_ts", watermark)
    return (
        timed.groupBy(*keys, F.session_window("_ts", f"{gap} seconds").alias("_w"))
        .agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n"))
        .drop("_w")
    )
