"""Recorded sessions, message bodies and patches from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwise.schemas import SESSION


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """A recorded session (JSON lines). Blank lines are skipped, a malformed line fails the job.

    ``source_file`` is the name of the file each line came from.
    """
    reader = spark.read.schema(SESSION).option("mode", "FAILFAST").option("recursiveFileLookup", "true")
    lines = reader.json(path)
    return lines.select("*", F.col("_metadata.file_name").alias("source_file"))


def read_body(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as message bodies, one row ``(value, path)`` each."""
    bodies = spark.read.text(path, wholetext=True)
    return bodies.select("value", F.col("_metadata.file_path").alias("path"))


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Patches ``(topic, partition, offset, patched_payload)`` from JSON lines.

    ``patched_payload`` may be a JSON object or a string; an object is sent as JSON text.
    """
    schema = "topic string, partition int, offset bigint, patched_payload string"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
