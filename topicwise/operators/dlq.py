"""Dead-letter diagnosis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwise.functions.text import bytes_text, digits_or_null, exception_class, header, non_empty
from topicwise.operators.limits import first_in_scan


@dataclass(frozen=True)
class Rule:
    """A failure class: the first rule whose pattern is found, ignoring case, gives the diagnosis."""

    pattern: str
    category: str
    cause: str
    action: str


# Patterns and texts of the diagnoses, in order of precedence.
DEFAULT_RULES = (
    Rule(
        "JsonParse|Unexpected character|Expecting value|JSONDecodeError|invalid json",
        "Deserialization Syntax Error",
        "Corrupted or incomplete JSON syntax in message payload.",
        "Fix malformed JSON brackets, quotes, or characters in the payload.",
    ),
    Rule(
        "ValidationException|ConstraintViolation|missing required|pattern mismatch|invalid field",
        "Schema Validation Failure",
        "Payload fails structural or constraint validation in consumer.",
        "Update rejected properties to satisfy contract constraints.",
    ),
    Rule(
        "DecodeError|Truncated message|wire type|invalid tag|protobuf",
        "Protobuf Deserialization Failure",
        "Binary payload does not match expected Protobuf schema definition.",
        "Verify schema contract version or synchronize message definition.",
    ),
    Rule(
        "TimeoutException|ConnectException|ConnectionRefused|ConnectionError|SocketTimeout|503|504",
        "Downstream Service Outage",
        "Processing failed due to temporary network or dependency unavailability.",
        "Safe to redrive directly without altering payload once service recovers.",
    ),
    Rule(
        "Duplicate|AlreadyExists|ConflictException|OptimisticLock",
        "Idempotency or Conflict Rejection",
        "Message with this identifier was already processed or caused state conflict.",
        "Inspect entity state before redriving to avoid unintended duplicates.",
    ),
    Rule(
        "NullPointerException|AttributeError|KeyError|IndexError",
        "Uncaught Null / Key Exception",
        "Consumer crashed expecting a field that was not present in the payload.",
        "Supply the missing property in the payload editor.",
    ),
)
NO_RULE_CATEGORY = "Unclassified Error"
NO_RULE_CAUSE = "Unknown error occurred during processing."
NO_RULE_ACTION = "Review stack trace and inspect payload fields."

DIAGNOSIS = (
    "failure_category",
    "root_cause",
    "suggested_action",
    "original_topic",
    "original_partition",
    "original_offset",
    "exception_type",
    "exception_message",
    "stack_trace",
)


def diagnose(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Add the nine diagnosis columns. One lazy CASE over the rules, no shuffle.

    They leave through a one-row generator, so that a filter on the category does not carry copies of all rules, and
    of the header lookups inside them, down to the scan.
    """
    headers = F.col("headers")
    df = df.withColumns(
        {
            "exception_message": F.coalesce(
                header(headers, "x-exception-message", "deadletter.reason"), non_empty("error_message")
            ),
            "stack_trace": header(headers, "x-exception-stacktrace"),
            "original_topic": headers["x-original-topic"],
            "original_partition": digits_or_null(headers["x-original-partition"]),
            "original_offset": digits_or_null(headers["x-original-offset"]),
        }
    )
    text = F.concat(F.coalesce("exception_message", F.lit("")), F.lit("\n"), F.coalesce("stack_trace", F.lit("")))
    df = df.withColumn("_text", text)
    number = F.lit(len(rules))
    for at in range(len(rules) - 1, -1, -1):
        number = F.when(F.rlike("_text", F.lit(f"(?i){rules[at].pattern}")), at).otherwise(number)
    df = df.withColumns({"_rule": number, "exception_type": exception_class("_text")})

    def pick(texts: list[str], otherwise) -> F.Column:
        known = F.array(*[F.lit(t) for t in texts])
        return F.coalesce(F.get(known, F.col("_rule")), otherwise)

    found = {
        "failure_category": pick([r.category for r in rules], F.lit(NO_RULE_CATEGORY)),
        "root_cause": pick([r.cause for r in rules], F.coalesce("exception_message", F.lit(NO_RULE_CAUSE))),
        "suggested_action": pick([r.action for r in rules], F.lit(NO_RULE_ACTION)),
    }
    kept = [c for c in df.columns if c not in DIAGNOSIS and c not in ("_text", "_rule")]
    diagnosis = F.struct(*[found.get(name, F.col(name)).alias(name) for name in DIAGNOSIS])
    return df.select(*kept, F.inline(F.array(diagnosis)))


def inspect(df: DataFrame, limit: int = 10, rules: Sequence[Rule] | None = DEFAULT_RULES) -> DataFrame:
    """The first ``limit`` dead letters in scan order; with diagnosis unless ``rules`` is None."""
    first = first_in_scan(df, limit)
    return first if rules is None else diagnose(first, rules)


def by_category(diagnosed: DataFrame) -> DataFrame:
    """Dead letters per failure category, and how many of them know where to be sent."""
    target = F.coalesce(non_empty("original_topic"), F.lit(None))
    return diagnosed.groupBy("failure_category").agg(
        F.count(F.lit(1)).alias("records"), F.count(target).alias("with_target")
    )


def link_source(dead: DataFrame, source: DataFrame) -> DataFrame:
    """Add ``source_value`` and ``source_timestamp_ms`` of the record each diagnosed dead letter came from.

    ``source`` may be RAW: neither column needs decoding.

    A dead letter without coordinates gets a key of its own that no record has; NULL keys would all meet in one task.
    """
    if "timestamp_ms" not in source.columns:
        source = source.withColumns({"timestamp_ms": F.unix_millis("timestamp"), "value": bytes_text(non_empty("value"))})
    found = source.select(
        F.col("topic").alias("_topic"),
        F.col("partition").cast("bigint").alias("_partition"),
        F.col("offset").alias("_offset"),
        F.col("value").alias("source_value"),
        F.col("timestamp_ms").alias("source_timestamp_ms"),
    )
    known = F.col("original_topic").isNotNull() & F.col("original_partition").isNotNull() & F.col("original_offset").isNotNull()
    keyed = dead.withColumns(
        {
            "_topic": F.when(known, F.col("original_topic")).otherwise(""),
            "_partition": F.when(known, F.col("original_partition")).otherwise(-1).cast("bigint"),
            "_offset": F.when(known, F.col("original_offset")).otherwise(-1 - F.col("offset")).cast("bigint"),
        }
    )
    on = ["_topic", "_partition", "_offset"]
    return keyed.join(found, on, "left").drop(*on)
