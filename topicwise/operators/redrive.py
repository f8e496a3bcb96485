"""Plans for sending dead letters back, one by one, patched, or in filtered batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicwise.functions.text import header, header_array, non_empty, with_headers
from topicwise.operators.dlq import diagnose
from topicwise.operators.filters import in_category, target_topic, with_parsed_value
from topicwise.operators.limits import GROUP_LIMIT, SCAN_ORDER, nth_position, position

# Headers taken off a redriven record, the provenance headers set on it, the error text, and the
# name shown when no target is known.
STRIPPED_HEADERS = (
    "x-exception-message",
    "x-exception-stacktrace",
    "x-original-topic",
    "x-original-partition",
    "x-original-offset",
    "deadletter.reason",
    "x-death",
)
REDRIVEN_BY = "x-redriven-by"
REDRIVE_TOPIC = "x-redrive-source-topic"
REDRIVE_OFFSET = "x-redrive-source-offset"
NO_TARGET_ERROR = "Target topic unspecified and 'x-original-topic' header missing."
UNKNOWN = "unknown"


def strip_headers(headers: Column) -> Column:
    """Without the dead-letter headers, whatever their case."""
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*STRIPPED_HEADERS))


def with_patches(dead: DataFrame, patches: DataFrame) -> DataFrame:
    """Add ``patched_payload`` from ``patches(topic, partition, offset, patched_payload)``; NULL where there is none."""
    on = list(SCAN_ORDER)
    return dead.join(patches.select(*on, "patched_payload"), on, "left")


def already_sent(dead: DataFrame, ledger: DataFrame) -> DataFrame:
    """Leave out records whose coordinates a ledger of earlier redrives lists. Redriving is at-least-once without it."""
    on = list(SCAN_ORDER)
    return dead.join(ledger.select(*on), on, "left_anti")


def plan_redrive(
    dead: DataFrame, target: str | None = None, strip: bool = True, redriven_by: str = "topicwise"
) -> DataFrame:
    """One outgoing record per dead letter.

    ``topic``, ``key``, ``value`` and ``headers`` are what a Kafka sink takes; ``success`` and ``error`` tell whether the
    row can be sent. The value is the patch (column ``patched_payload``, if there), else the original bytes, else
    the payload as JSON, else the text. A tombstone stays a tombstone.
    """
    patch = F.col("patched_payload") if "patched_payload" in dead.columns else F.lit(None).cast("string")
    body = F.coalesce(
        patch.cast("binary"), F.col("raw_value"), F.to_json("payload").cast("binary"), F.col("value").cast("binary")
    )
    headers = F.col("headers")
    sent_headers = with_headers(
        strip_headers(headers) if strip else headers,
        {REDRIVEN_BY: F.lit(redriven_by), REDRIVE_TOPIC: F.col("topic"), REDRIVE_OFFSET: F.col("offset").cast("string")},
    )
    destination = target_topic(target)
    return dead.select(
        F.coalesce(destination, F.lit("")).alias("topic"),
        F.coalesce(non_empty("raw_key"), F.col("key").cast("binary")).alias("key"),
        body.alias("value"),
        header_array(sent_headers).alias("headers"),
        F.col("topic").alias("source_topic"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        destination.isNotNull().alias("success"),
        F.when(destination.isNull(), NO_TARGET_ERROR).alias("error"),
    )


def redrive_batch(
    dead: DataFrame,
    target: str | None = None,
    category: str | None = None,
    predicate: Column | str | None = None,
    dry_run: bool = False,
    limit: int | None = None,
    strip: bool = True,
    redriven_by: str = "topicwise",
) -> tuple[DataFrame, DataFrame]:
    """``(plan, summary)`` of a filtered batch redrive, scanned by topic, partition, offset.

    A record without target, outside the category (substring, ignoring case) or failing the predicate is skipped.
    ``limit`` stops after that many matches: later records are neither matched nor skipped. A dry run
    reports each record's own coordinates as produced; a real run leaves them NULL, as the sink does not return them.
    """
    flagged = diagnose(dead).withColumn("_target", target_topic(target))
    matched = F.col("_target").isNotNull()
    if category:
        matched = matched & in_category(category)
    flagged = _flag(flagged, matched, predicate)

    wanted = flagged.filter("_matched")
    if limit:
        cutoff = nth_position(wanted, limit).scalar()
        wanted = _first(wanted, limit, cutoff)
    plan = plan_redrive(wanted, target, strip, redriven_by).withColumns(
        {
            "produced_partition": F.col("source_partition") if dry_run else F.lit(None).cast("int"),
            "produced_offset": F.col("source_offset") if dry_run else F.lit(None).cast("bigint"),
        }
    )

    is_match = F.col("_matched")
    first = F.min_by(F.struct("topic", header("headers", "x-original-topic").alias("target")), position())
    counters = {
        "first": first,
        "total_scanned": F.count(F.lit(1)),
        "all_matched": F.count_if(is_match),
        "all_skipped": F.count_if(~is_match),
    }
    if limit:
        counters["skipped_before"] = F.count_if(~is_match & (position() < cutoff))
    totals = flagged.agg(*[c.alias(name) for name, c in counters.items()])
    matched_count, skipped = F.col("all_matched"), F.col("all_skipped")
    if limit:
        reached = matched_count >= limit
        skipped = F.when(reached, F.col("skipped_before")).otherwise(skipped)
        matched_count = F.least(matched_count, F.lit(limit))
    own_target = F.coalesce("first.target", F.lit(UNKNOWN))
    summary = totals.select(
        F.coalesce("first.topic", F.lit(UNKNOWN)).alias("source_topic"),
        (F.lit(target) if target else own_target).alias("target_topic"),
        "total_scanned",
        matched_count.cast("bigint").alias("matched_count"),
        matched_count.cast("bigint").alias("redriven_count"),
        skipped.cast("bigint").alias("skipped_count"),
        F.lit(0).cast("bigint").alias("failed_count"),
        F.lit(dry_run).alias("dry_run"),
    )
    return plan, summary


def _first(wanted: DataFrame, limit: int, cutoff: Column) -> DataFrame:
    """The first ``limit`` records in scan order; of several stored at one place those of the smallest values.

    A small limit is one top-k over one scan. A larger one searches ``cutoff`` first, so that no task holds all of them.
    """
    if limit <= GROUP_LIMIT:
        return wanted.orderBy(*SCAN_ORDER, "value").limit(limit)
    # Several records may be stored at the last place: only as many of them as still fit.
    before = wanted.filter(position() < cutoff).agg(F.count(F.lit(1))).scalar()
    rank = F.row_number().over(Window.partitionBy(*SCAN_ORDER).orderBy("value"))
    last = wanted.filter(position() == cutoff).withColumn("_rank", rank).filter(F.col("_rank") <= limit - before)
    return wanted.filter(position() < cutoff).unionByName(last.drop("_rank"))


def _flag(df: DataFrame, matched: Column, predicate: Column | str | None) -> DataFrame:
    """Add ``_matched``. The predicate sees the same payload as in ``filter_events``."""
    if predicate is None:
        return df.withColumn("_matched", matched)
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    flagged = with_parsed_value(df).withColumn("_matched", F.coalesce(matched & condition, F.lit(False)))
    return flagged.withColumn("payload", F.col("_decoded")).drop("_decoded")
