"""Partitions, watermarks and consumer lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicwise.functions.display import lag_bar_percent, lag_meter, lag_percent, lag_severity


def topic_partitions(records: DataFrame) -> DataFrame:
    """The partitions of each topic, in order."""
    return records.select("topic", "partition").distinct().orderBy("topic", "partition")


def offsets(records: DataFrame) -> DataFrame:
    """First offset and end offset (last + 1) of each partition."""
    return records.groupBy("topic", "partition").agg(
        F.min("offset").alias("beginning_offset"), (F.max("offset") + 1).alias("log_end_offset")
    )


def lag_by_partition(ends: DataFrame, committed: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """Lag of each (group, topic, partition): end minus committed offset, never negative.

    ``ends`` has ``topic, partition, log_end_offset``; ``committed`` has ``group_id, topic, partition, committed_offset``.
    With a group, a partition it never committed counts from 0. Without one there is no lag, and the group is ``none``.
    ``group=None`` with ``committed`` reports every group over the topics it committed to.
    """
    if committed is None and group is None:
        return ends.select(
            F.lit("none").alias("group_id"),
            "topic",
            "partition",
            "log_end_offset",
            F.col("log_end_offset").alias("current_offset"),
            F.lit(0).cast("bigint").alias("lag"),
        )
    if committed is None:
        known = ends.withColumns({"group_id": F.lit(group), "committed_offset": F.lit(None).cast("bigint")})
    elif group is not None:
        own = committed.filter(F.col("group_id") == group).select("topic", "partition", "committed_offset")
        known = ends.join(own, ["topic", "partition"], "left").withColumn("group_id", F.lit(group))
    else:
        expected = ends.join(committed.select("group_id", "topic").distinct(), "topic")
        known = expected.join(committed, ["group_id", "topic", "partition"], "left")
    current = F.coalesce("committed_offset", F.lit(0)).cast("bigint")
    return known.select(
        "group_id",
        "topic",
        "partition",
        "log_end_offset",
        current.alias("current_offset"),
        F.greatest(F.lit(0), F.col("log_end_offset") - current).cast("bigint").alias("lag"),
    )


def lag_total(by_partition: DataFrame, topics: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """Total lag and partition count per group and topic.

    ``topics(topic)`` adds asked-for topics without partitions: lag 0, group ``unassigned`` unless one is given.
    """
    totals = by_partition.groupBy("group_id", "topic").agg(
        F.sum("lag").cast("bigint").alias("total_lag"), F.count(F.lit(1)).alias("partitions")
    )
    if topics is None:
        return totals
    missing = topics.select("topic").distinct().join(totals.select("topic").distinct(), "topic", "left_anti")
    zero = F.lit(0).cast("bigint")
    return totals.unionByName(
        missing.select(F.lit(group or "unassigned").alias("group_id"), "topic", zero.alias("total_lag"), zero.alias("partitions"))
    )


def lag_share(by_partition: DataFrame) -> DataFrame:
    """Share of each partition in its group's lag on the topic; 0 where there is no lag. Partitions are few."""
    total = F.sum("lag").over(Window.partitionBy("group_id", "topic"))
    return by_partition.withColumn("lag_share", F.when(total > 0, F.col("lag") / total).otherwise(0.0))


def lag_view(by_partition: DataFrame) -> DataFrame:
    """Severity and meter of each partition as the console and the page show them, in partition order."""
    lag = F.col("lag")
    return by_partition.withColumns(
        {
            "severity": lag_severity(lag),
            "meter": lag_meter(lag),
            "page_severity": lag_severity(lag, 100, 30, ("danger", "warn", "")),
            "percent": lag_percent(lag),
            "bar_percent": lag_bar_percent(lag),
        }
    ).orderBy("group_id", "topic", "partition")
