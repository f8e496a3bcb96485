"""Row filters. All are narrow; conjuncts over topic, partition, offset and timestamp reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwise.functions.payload import payload_text, strict_json
from topicwise.functions.text import header


def filter_events(df: DataFrame, predicate: Column | str | None = None, regex: str | None = None) -> DataFrame:
    """Keep the records matching every rule given; without rules, all.

    ``predicate`` is a Spark SQL condition over ``payload``, ``headers``, ``key`` and the other record columns.
    It sees the value parsed as JSON where decoding gave no structured payload. Use the ``try_`` functions and
    ``json_num`` / ``json_truthy``: NULL means no match.

    ``regex`` is searched without regard to case in the payload text, the key, and each header as ``name:value``.
    Payload text is compact JSON with sorted keys, so a pattern across a separator needs ``\\s*``.
    """
    if regex is not None and regex != "":
        df = df.filter(matches_regex(regex))
    if predicate is None or (isinstance(predicate, str) and predicate == ""):
        return df
    if not {"payload", "value"} <= set(df.columns):
        return df.filter(predicate)
    return with_parsed_value(df).filter(predicate).withColumn("payload", F.col("_decoded")).drop("_decoded")


def with_parsed_value(df: DataFrame) -> DataFrame:
    """Payload for predicates: where nothing structured was decoded, the value parsed as JSON. Keeps ``_decoded``."""
    return df.withColumn("_decoded", F.col("payload")).withColumn(
        "payload", F.coalesce("payload", strict_json("value"))
    )


def matches_regex(pattern: str) -> Column:
    p = F.lit(f"(?iu){pattern}")
    in_headers = F.exists(
        F.map_entries("headers"), lambda e: F.rlike(F.concat(e["key"], F.lit(":"), e["value"]), p)
    )
    return (
        F.rlike(F.coalesce(payload_text(), F.lit("")), p)
        | F.coalesce(F.rlike("key", p), F.lit(False))
        | F.coalesce(in_headers, F.lit(False))
    )


def keyword_filter(df: DataFrame, keyword: str) -> DataFrame:
    """Case-insensitive substring of the whole record written as JSON. An empty keyword keeps everything."""
    if not keyword:
        return df
    return df.filter(F.contains(F.lower(record_json()), F.lit(keyword.lower())))


def record_json() -> Column:
    """The record summary as one JSON text, with the payload nested as JSON."""
    fields = [
        "topic",
        "partition",
        "offset",
        F.col("timestamp_ms").alias("timestamp"),
        "key",
        F.col("payload_format").alias("format"),
        "is_dlq",
        "headers",
    ]
    nested = F.to_json(F.struct(*fields, "payload"), {"ignoreNullFields": "false"})
    plain = F.to_json(F.struct(*fields, F.col("value").alias("payload")), {"ignoreNullFields": "false"})
    return F.when(F.col("payload").isNotNull(), nested).otherwise(plain)


def dlq_only(df: DataFrame) -> DataFrame:
    return df.filter("is_dlq")


def in_category(category: str) -> Column:
    """Failure category contains the text, ignoring case."""
    return F.contains(F.lower("failure_category"), F.lit(category.lower()))


def target_topic(target: str | None = None) -> Column:
    """Where a dead letter goes: the given topic, else its original topic, else NULL."""
    own = header("headers", "x-original-topic")
    return F.lit(target) if target else own


def has_target(target: str | None = None) -> Column:
    return target_topic(target).isNotNull()
