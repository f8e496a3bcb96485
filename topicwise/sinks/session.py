"""Recording records as a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from topicwise.operators.limits import stop_after
from topicwise.schemas import SESSION


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def session_rows(records: DataFrame, recorded_ms: Column | None = None) -> DataFrame:
    """RECORD rows as session lines, stamped with the present time unless told otherwise."""
    return records.select(
        (now_ms() if recorded_ms is None else recorded_ms).alias("time_recorded_ms"),
        "topic",
        "partition",
        "offset",
        F.col("timestamp_ms").alias("timestamp"),
        "key",
        "value",
        "headers",
        "payload_format",
        "is_dlq",
    ).select(*SESSION.names)


def write_session(
    records: DataFrame, path: str, max_messages: int | None = None, recorded_ms: Column | None = None
) -> int:
    """Write a session as JSON lines and return how many records it has, counted by the write itself.

    ``max_messages`` keeps the first records by topic, partition, offset; every task writes its own part of them.
    """
    rows = session_rows(records if max_messages is None else stop_after(records, max_messages), recorded_ms)
    counted = Observation()
    rows.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option(
        "ignoreNullFields", "false"
    ).json(path)
    return counted.get["n"]
