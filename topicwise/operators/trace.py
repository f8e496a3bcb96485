"""Correlated event paths across topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwise.functions.payload import json_text, payload_text
from topicwise.functions.text import non_empty
from topicwise.operators import matching
from topicwise.operators.sequence import BUCKET_MS, follow
from topicwise.session import staged

# Where a correlation id is looked for.
CORRELATION_HEADERS = ("x-correlation-id", "x-trace-id", "correlation_id", "traceparent", "x-b3-traceid")
CORRELATION_FIELDS = ("order_id", "event_id", "transaction_id", "correlation_id", "customer_id")

HOP_COLUMNS = (
    "topic",
    "partition",
    "offset",
    "timestamp_ms",
    "key",
    "event_type",
    "is_dlq",
    "status",
    "error_message",
    "headers",
    "payload_text",
)


def searched_texts() -> list[Column]:
    """The eleven texts an id is searched in. NULL and empty texts never match."""
    return [
        F.col("key"),
        *[F.col("headers")[name] for name in CORRELATION_HEADERS],
        *[json_text("payload", f"$.{name}") for name in CORRELATION_FIELDS],
    ]


def matches_correlation(correlation_id: str) -> Column:
    """The id is a substring, ignoring case, of the key, a correlation header or an id field of the payload."""
    wanted = F.lit(correlation_id.lower())
    hit = F.lit(False)
    for text in searched_texts():
        hit = hit | F.coalesce(F.contains(F.lower(non_empty(text)), wanted), F.lit(False))
    return hit


def _as_hops(records: DataFrame, correlation_id: Column, *more: Column) -> DataFrame:
    return records.select(
        correlation_id.alias("correlation_id"),
        "topic",
        "partition",
        "offset",
        "timestamp_ms",
        "key",
        json_text("payload", "$.event_type").alias("event_type"),
        "is_dlq",
        F.when(F.col("is_dlq"), "DLQ_POISON").otherwise("OK").alias("status"),
        "error_message",
        "headers",
        payload_text().alias("payload_text"),
        *more,
    )


def _with_latency(
    hops: DataFrame, bucket_ms: int | None, keys: tuple[str, ...] = ("correlation_id",)
) -> DataFrame:
    linked = follow(hops, keys, "timestamp_ms", "_prev", "step", bucket_ms)
    gap = F.col("timestamp_ms") - F.col("_prev")
    latency = F.when(gap.isNotNull(), F.greatest(F.lit(0), gap)).cast("double")
    return linked.select("correlation_id", "step", *HOP_COLUMNS, latency.alias("latency_ms"))


def trace_hops(records: DataFrame, correlation_id: str, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Time-ordered hops of the records matching one id, with step, latency since the previous hop and status."""
    matched = _as_hops(records.filter(matches_correlation(correlation_id)), F.lit(correlation_id))
    return _with_latency(_found(matched, bucket_ms), bucket_ms, keys=())


def _found(hops: DataFrame, bucket_ms: int | None) -> DataFrame:
    """Hops that a search found, written once: linking reads their keys and times beforehand, and need not search the log again."""
    return hops if bucket_ms is None else staged(hops, "hops")


def trace_all(records: DataFrame, id_expr: Column | str, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Hops of every trace at once, grouped by an id expression. Records without an id are in no trace."""
    id_column = F.expr(id_expr) if isinstance(id_expr, str) else id_expr
    hops = _as_hops(records, id_column).filter(F.col("correlation_id") != "")
    return _with_latency(hops, bucket_ms)


# Largest id table, in ids and in characters, that is sent whole to every task.
BROADCAST_IDS = 200_000
BROADCAST_CHARS = 8_000_000


def pair_with_ids(records: DataFrame, ids: DataFrame, exact: bool = False) -> DataFrame:
    """Records paired with every id of ``ids(correlation_id)`` that one of their texts contains, or equals if ``exact``."""
    return _paired(records.withColumn("_texts", _lower_texts()), ids, exact).select(*records.columns, "correlation_id")


def _lower_texts() -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.lower(t) for t in searched_texts()])))


def _paired(rows: DataFrame, ids: DataFrame, exact: bool) -> DataFrame:
    """Rows with ``_texts`` (and the coordinates) paired with the ids.

    An equi-join: each row offers its texts, or for a substring search the windows of its texts that some id may be filed
    under (see ``operators.matching``). No row is compared with every id, and the plan does not grow with the ids' lengths.

    Small jobs first measure the ids. Up to the limits above they are broadcast. Beyond, the rows are written once under numbers of
    their own: only these numbers, single texts and offers are shuffled, and the rows are joined to the pairs found.
    """
    wanted = ids.select("correlation_id", F.lower("correlation_id").alias("_id")).filter("_id <> ''").distinct()
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("_id")), F.lit(0)).alias("chars")).first()
    if exact:
        filed, holds = wanted.withColumn("_filed", F.col("_id")), F.lit(True)
    else:
        windows = matching.anchors(wanted.select("_id").distinct(), "_id").withColumnRenamed("window", "_filed")
        filed = staged(wanted.join(windows, "_id"), "filed-ids")
        holds = matching.is_first("_data") & F.exists("_texts", lambda t: F.contains(t, F.col("_id")))

    def offers(frame: DataFrame) -> DataFrame:
        if exact:
            return frame.withColumn("_offer", F.explode("_texts"))
        data = frame.withColumn("_data", F.array_join("_texts", "\x00").cast("binary"))
        return matching.likely_windows(data, "_data", filed.select("width", F.col("_filed").alias("window")), size.n)

    sought = filed.select("_filed", "_id", "correlation_id")
    if size.n <= BROADCAST_IDS and size.chars <= BROADCAST_CHARS:
        return offers(rows).join(F.broadcast(sought), F.col("_offer") == F.col("_filed")).filter(holds)
    named = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "searched")
    texts = named.select("_row", F.explode("_texts").alias("_text")).select("_row", F.array("_text").alias("_texts"))
    met = offers(texts).join(sought, F.col("_offer") == F.col("_filed")).filter(holds)
    # Dealt by row, so neither finding an id once per row nor the join moves the pairs again.
    pairs = met.select("_row", "correlation_id").repartition("_row").distinct()
    return named.join(pairs, "_row")


def trace_many(
    records: DataFrame, ids: DataFrame, exact: bool = False, bucket_ms: int | None = BUCKET_MS
) -> DataFrame:
    """Hops for every id of a table. ``exact=True`` requires a whole text to equal the id instead of containing it."""
    # What a hop shows is made once per record, before it is paired with several ids.
    hops = _as_hops(records, F.lit(None).cast("string"), _lower_texts().alias("_texts")).drop("correlation_id")
    return _with_latency(_found(_paired(hops, ids, exact).select("correlation_id", *HOP_COLUMNS), bucket_ms), bucket_ms)


TRACE_TOPICS = (
    "correlation_id string, topic string, n bigint, first_ts bigint, last_ts bigint, first_seen decimal(38,0), has_dlq boolean"
)


def trace_summary(hops: DataFrame) -> DataFrame:
    """One row per trace: hop count, total latency, dead-letter flag, topics in order of first sight.

    Takes hops or any frame with ``correlation_id``, the coordinates, ``timestamp_ms`` and ``is_dlq``. Rows collapse per
    (trace, topic) before they are shuffled, so the size of a trace does not matter. The total is NULL for fewer than
    two hops, or when the first or the last time is missing or 0.
    """
    return summary_of_topics(trace_topics(hops))


def trace_topics(hops: DataFrame) -> DataFrame:
    """One row per trace and topic, ``TRACE_TOPICS``. Rows of parts of a log merge: n by sum, the others by min, max or any."""
    ts = F.coalesce("timestamp_ms", F.lit(0)).cast("decimal(38,0)")
    # (time, offset) packed into one number: it sorts like the pair, and min() of a number needs no sort.
    first_seen = F.min(ts * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col("offset"))
    return hops.groupBy("correlation_id", "topic").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.coalesce("timestamp_ms", F.lit(0))).alias("first_ts"),
        F.max(F.coalesce("timestamp_ms", F.lit(0))).alias("last_ts"),
        first_seen.alias("first_seen"),
        F.bool_or("is_dlq").alias("has_dlq"),
    )


def summary_of_topics(per_topic: DataFrame) -> DataFrame:
    """:func:`trace_summary` of merged :func:`trace_topics`."""
    seen = F.array_sort(F.collect_list(F.struct("first_seen", "topic")))
    totals = per_topic.groupBy("correlation_id").agg(
        F.sum("n").cast("bigint").alias("hops"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.bool_or("has_dlq").alias("has_dlq"),
        seen.alias("seen"),
    )
    known = (F.col("hops") >= 2) & (F.col("first_ts") != 0) & (F.col("last_ts") != 0)
    return totals.select(
        "correlation_id",
        "hops",
        F.when(known, F.col("last_ts") - F.col("first_ts")).cast("double").alias("total_latency_ms"),
        "has_dlq",
        F.transform("seen", lambda s: s["topic"]).alias("topics"),
    )
