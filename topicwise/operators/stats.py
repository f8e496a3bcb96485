"""Counters over records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(records: DataFrame) -> DataFrame:
    """Records and dead letters per topic."""
    return records.groupBy("topic").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("is_dlq")).alias("dlq_events")
    )


def throughput(records: DataFrame, width: str = "1 second") -> DataFrame:
    """Records per tumbling window of event time; those without a time are one row with a NULL window.

    The window is plain arithmetic, not ``F.window``, which drops rows without a time.
    """
    start = F.expr(f"timestamp_ms - pmod(timestamp_ms, {_milliseconds(width)}L)")
    return records.groupBy(start.alias("window_start_ms")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("is_dlq")).alias("dlq_events")
    )


def _milliseconds(width: str) -> int:
    """A width such as ``10 seconds`` or ``1 minute`` in milliseconds."""
    number, unit = width.split()
    units = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    return int(number) * units[unit.rstrip("s")]
