"""Cuts of a time-ordered row sequence wherever the silence exceeds a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 12 * 60 * 60


def session_numbers(rows: DataFrame, keys: Sequence[str], order: Sequence[str], t: str = "t", gap: int = GAP_SECONDS) -> DataFrame:
    """Adds ``session_no``: 0 for a key's first session, one more after each silence longer than ``gap`` seconds.

    ``order`` fixes the sequence (raw date, then an id against ties); gaps compare ``t`` in whole seconds. A gap of
    exactly ``gap`` doesn't cut. One exchange on ``keys``, one sort, both shared by the two windows and by a
    groupBy on ``keys`` plus ``session_no`` that may follow. Windows spill, so that a long chat needs no memory of its size.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    silent = F.col(t) - F.lag(t).over(ordered) > gap
    return rows.withColumn("_cut", F.coalesce(silent, F.lit(False)).cast("bigint")).withColumn("session_no", F.sum("_cut").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def sessionize(rows: DataFrame, keys: Sequence[str], order: Sequence[str], t: str = "t", gap: int = GAP_SECONDS) -> DataFrame:
    """One row per session: keys, session_no, start, end, n."""
    return (
        session_numbers(rows, keys, order, t, gap)
        .groupBy(*keys, "session_no")
        .agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n"))
    )
