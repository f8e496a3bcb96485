"""Exports of records: JSON array, JSON lines, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicwise.operators.filters import record_json
from topicwise.operators.views import summary_view

# The columns of a CSV export, in order.
CSV_COLUMNS = ("Topic", "Partition", "Offset", "Key", "Format", "Timestamp", "Is_DLQ", "Payload")


def csv_rows(records: DataFrame) -> DataFrame:
    summary = summary_view(records).select(
        "topic", "partition", "offset", "key", "format", "timestamp", "is_dlq", "payload"
    )
    return summary.toDF(*CSV_COLUMNS)


def json_lines(records: DataFrame) -> DataFrame:
    return records.select(record_json().alias("line"))


def json_array_lines(records: DataFrame) -> DataFrame:
    """Lines which, read in order, are one JSON array: a bracket, one record per line, a bracket.

    Sorted over all tasks by scan position, so the part files written from it, put together by name, are the document.
    """
    place = F.struct("topic", "partition", "offset")
    first = records.select(F.min(place)).scalar()
    # Only the records stored at the first place are numbered, as one of them opens the array.
    line = record_json()
    at_first = records.filter(place.eqNullSafe(first)).select("topic", "partition", "offset", line.alias("line"))
    opens = F.row_number().over(Window.partitionBy("topic", "partition", "offset").orderBy("line")) == 1
    at_first = at_first.withColumn("line", F.concat(F.when(opens, " ").otherwise(","), "line"))
    others = records.filter(~place.eqNullSafe(first)).select("topic", "partition", "offset", F.concat(F.lit(","), line).alias("line"))
    opening = F.when(F.startswith("line", F.lit(" ")), 1).otherwise(2)
    body = at_first.unionByName(others).select(opening.alias("section"), "topic", "partition", "offset", "line")
    ends = records.sparkSession.createDataFrame([(0, "["), (3, "]")], "section int, line string").select(
        "section",
        F.lit("").alias("topic"),
        F.lit(0).alias("partition"),
        F.lit(0).cast("bigint").alias("offset"),
        "line",
    )
    return body.unionByName(ends).orderBy("section", "topic", "partition", "offset").select("line")


def export(records: DataFrame, path: str, fmt: str = "json", dlq_only: bool = False) -> None:
    """Write all records given (or their dead letters) as ``csv`` with a header, ``ndjson``, or else a JSON array."""
    if dlq_only:
        records = records.filter("is_dlq")
    if fmt == "csv":
        csv_rows(records).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    elif fmt == "ndjson":
        json_lines(records).write.mode("overwrite").text(path)
    else:
        json_array_lines(records).write.mode("overwrite").text(path)
