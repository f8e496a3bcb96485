"""Outgoing messages: from templates, from redrive plans, from recorded sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicwise.functions.text import header_array, parse_header_text, with_headers
from topicwise.operators.sequence import BUCKET_MS, running_delay
from topicwise.sources.kafka import KafkaConfig

# Provenance headers of a replayed record, and the longest pause between two of them.
REPLAYED_BY = "x-replayed-by"
REPLAY_FILE = "x-replay-source-file"
MAX_DELAY_S = 5.0

MESSAGE = ("topic", "key", "value", "headers")


def as_bytes(df: DataFrame, name: str) -> Column:
    """Bytes stay, text becomes UTF-8, structures become JSON, anything else its text."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(c).cast("binary")
    return c if isinstance(kind, T.BinaryType) else c.cast("string").cast("binary")


def as_messages(df: DataFrame) -> DataFrame:
    """``topic, key, value, headers`` in the form a Kafka sink takes. Headers may be a map or already an array."""
    headers = F.lit(None).cast("array<struct<key:string,value:binary>>")
    if "headers" in df.columns:
        is_map = isinstance(df.schema["headers"].dataType, T.MapType)
        headers = header_array("headers") if is_map else F.col("headers")
    key = as_bytes(df, "key") if "key" in df.columns else F.lit(None).cast("binary")
    return df.select("topic", key.alias("key"), as_bytes(df, "value").alias("value"), headers.alias("headers"))


def publish(df: DataFrame, config: KafkaConfig | None = None) -> None:
    """Write the records to Kafka in parallel. At-least-once: a retried task sends its rows again.

    Of a redrive plan only rows with ``success`` are sent.
    """
    ready = df.filter("success") if "success" in df.columns else df
    as_messages(ready).write.format("kafka").options(**(config or KafkaConfig()).options(producer=True)).save()


def publish_to_files(df: DataFrame, path: str, mode: str = "append") -> None:
    """The same messages as Parquet, for runs without a broker."""
    ready = df.filter("success") if "success" in df.columns else df
    as_messages(ready).write.mode(mode).parquet(path)


def message_template(
    spark: SparkSession, topic: str, value: str = "{}", key: str | None = None, header_text: str = "", count: int = 1
) -> DataFrame:
    """``count`` copies of one message, generated in the tasks. With several, the key gets ``_1``, ``_2``, ..."""
    numbered = spark.range(1, count + 1).withColumnRenamed("id", "copy")
    row = {"topic": F.lit(topic), "value": F.lit(value), "key": F.lit(key).cast("string"), "header_text": F.lit(header_text)}
    return _numbered_messages(numbered.withColumns(row), count)


def expand_messages(templates: DataFrame, count: int = 1) -> DataFrame:
    """``count`` copies of each row of ``templates(topic, value, key, header_text)``."""
    copies = templates.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(count).cast("bigint"))))
    return _numbered_messages(copies, count)


def _numbered_messages(df: DataFrame, count: int) -> DataFrame:
    suffixed = F.concat(F.col("key"), F.lit("_"), F.col("copy").cast("string"))
    key = F.when(F.col("key") != "", suffixed).otherwise(F.col("key")) if count > 1 else F.col("key")
    return df.select("topic", key.alias("key"), "value", parse_header_text("header_text").alias("headers"), "copy")


def replay_plan(
    session: DataFrame,
    target: str | None = None,
    speed: float = 1.0,
    dry_run: bool = False,
    replayed_by: str = "topicwise",
    source_file: str | None = None,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """A recorded session as messages to send again, with the pause before each, its time from the start and its place (``sequence``).

    Order is recording time, then offset, topic, partition. A pause is the recorded one divided by ``speed``, at most five
    seconds; none before the first record, after an unknown time, or for a speed of 0 or less.
    """
    filled = session.withColumns(
        {
            "partition": F.coalesce("partition", F.lit(0)),
            "offset": F.coalesce("offset", F.lit(0)),
            "payload_format": F.coalesce("payload_format", F.lit("raw")),
            "is_dlq": F.coalesce("is_dlq", F.lit(False)),
            "value": F.coalesce("value", F.lit("")),
            "_origin": F.col("topic"),
        }
    )

    def pause(previous: Column, current: Column) -> Column:
        if speed <= 0:
            return F.lit(0.0)
        recorded = F.greatest(F.lit(0), current - previous) / F.lit(1000.0) / F.lit(float(speed))
        known = previous.isNotNull() & current.isNotNull()
        return F.when(known, F.least(F.lit(MAX_DELAY_S), recorded)).otherwise(0.0)

    timed = running_delay(filled, "time_recorded_ms", pause, bucket_ms)
    name = F.lit(source_file) if source_file or "source_file" not in session.columns else F.col("source_file")
    no_headers = F.expr("cast(map() as map<string,string>)")
    headers = with_headers(
        F.coalesce("headers", no_headers), {REPLAYED_BY: F.lit(replayed_by), REPLAY_FILE: F.coalesce(name, F.lit(""))}
    )
    return timed.select(
        (F.lit(target) if target else F.col("_origin")).alias("topic"),
        "partition",
        "offset",
        "timestamp",
        "key",
        "value",
        headers.alias("headers"),
        "payload_format",
        "is_dlq",
        "delay_s",
        F.col("at_s").alias("replay_at_s"),
        "sequence",
        F.lit(not dry_run).alias("published"),
    )
