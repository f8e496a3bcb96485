"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicwise.functions.payload import json_num, json_text, json_truthy
from topicwise.operators import diff, dlq, filters, lag, limits, redrive, stats, trace, views
from topicwise.operators.decode import attach_schema, decode, flag, to_records
from topicwise.plans import inputs
from topicwise.session import scratch_dir
from topicwise.sinks import export, publish
from topicwise.sinks import session as sessions
from topicwise.sources import kafka
from topicwise.sources.files import read_patches, read_session
from topicwise.streaming import latency, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

COORDINATES = ("topic", "partition", "offset")
CORRELATION = "headers['x-correlation-id']"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Sources


@query
def tail_n_per_partition(spark, sf_dir):
    return to_records(limits.tail_n(inputs.raw(spark, sf_dir), 5), wire=False).select(
        *COORDINATES, "key", "payload_format"
    )


@query
def tail_long_per_partition(spark, sf_dir):
    return limits.tail_n(inputs.raw(spark, sf_dir), 1_100).groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("records"), F.min("offset").alias("first_offset")
    )


@query
def stop_before_filter(spark, sf_dir):
    """Dead letters among the first 700 records of the scan."""
    return flag(limits.stop_after(inputs.raw(spark, sf_dir), 700)).filter("is_dlq").select(*COORDINATES)


@query
def stop_after_filter(spark, sf_dir):
    """The scan ends after 70 matches."""
    fresh = flag(inputs.raw(spark, sf_dir)).filter("NOT is_dlq AND timestamp_ms % 3 = 0")
    return limits.stop_after(fresh, 70).select(*COORDINATES, "timestamp_ms")


@query
def read_offset_range(spark, sf_dir):
    raw = inputs.raw(spark, sf_dir)
    marks = lag.offsets(raw.filter("topic = 'payment.events'")).collect()  # one row per partition
    return kafka.in_ranges(raw, kafka.planned_ranges(marks, first=100, last=900)).select(
        *COORDINATES, F.unix_millis("timestamp").alias("timestamp_ms")
    )


@query
def read_one_partition(spark, sf_dir):
    return kafka.from_topics(inputs.raw(spark, sf_dir), "user.events", 2).select(
        *COORDINATES, F.unix_millis("timestamp").alias("timestamp_ms")
    )


@query
def read_topics(spark, sf_dir):
    several = kafka.from_topics(inputs.raw(spark, sf_dir), "payment.events, user.events.dlq")
    return several.groupBy("topic").agg(F.count(F.lit(1)).alias("records"))


@query
def topic_partitions(spark, sf_dir):
    return lag.topic_partitions(inputs.raw(spark, sf_dir))


@query
def partition_watermarks(spark, sf_dir):
    return lag.offsets(inputs.raw(spark, sf_dir))


@query
def record_lookup(spark, sf_dir):
    dead = dlq.diagnose(inputs.dead_letters(spark, sf_dir))
    wanted = dead.filter("original_offset IS NOT NULL").select(
        F.col("original_topic").alias("topic"),
        F.col("original_partition").cast("int").alias("partition"),
        F.col("original_offset").alias("offset"),
    )
    found = kafka.lookup(inputs.raw(spark, sf_dir), wanted)
    return found.select(*COORDINATES, F.col("key").cast("string").alias("key"))


# Normalisation and decoding


@query
def normalize_records(spark, sf_dir):
    return inputs.mixed_records(spark, sf_dir).select(
        *COORDINATES,
        "timestamp_ms",
        "key",
        "value",
        F.expr(CORRELATION).alias("correlation"),
        F.expr("size(headers)").cast("bigint").alias("header_count"),
        "is_dlq",
        "error_message",
    )


@query
def decode_formats(spark, sf_dir):
    return inputs.mixed_records(spark, sf_dir).groupBy("payload_format").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("is_structured").alias("structured"),
        F.count("schema_id").alias("framed"),
    )


@query
def decode_frames(spark, sf_dir):
    framed = inputs.mixed_records(spark, sf_dir).filter("payload_format = 'avro'")
    return framed.select(
        "offset",
        "schema_id",
        json_text("payload", "$._schema_id").alias("id_in_payload"),
        json_text("payload", "$.order_id").alias("order_id"),
        json_text("payload", "$._wire_format").alias("wire_format"),
        json_text("payload", "$.payload_hex").alias("payload_hex"),
        json_num("payload", "$.payload_length_bytes").cast("bigint").alias("payload_length"),
    )


@query
def schema_lookup(spark, sf_dir):
    known = attach_schema(inputs.mixed_records(spark, sf_dir), inputs.schema_registry(spark))
    return known.select("offset", "schema_id", "schema_definition", "schema_type")


@query
def decode_protobuf(spark, sf_dir):
    rows = to_records(inputs.protobuf_log(spark, sf_dir), inputs.order_message())
    return rows.select(
        "offset",
        "payload_format",
        json_text("payload", "$.event_id").alias("event_id"),
        json_text("payload", "$.order_id").alias("order_id"),
        json_text("payload", "$.currency").alias("currency"),
        json_text("payload", "$.sequence_number").alias("sequence_number"),
        F.col("decode_error").isNotNull().alias("failed"),
    )


@query
def decode_wire(spark, sf_dir):
    rows = to_records(inputs.protobuf_log(spark, sf_dir))
    return rows.select(
        "offset",
        "payload_format",
        json_text("payload", "$.tag_1").alias("tag_1"),
        json_text("payload", "$.tag_3").alias("tag_3"),
        json_num("payload", "$.tag_7").cast("bigint").alias("tag_7"),
    )


@query
def decode_all_kinds(spark, sf_dir):
    """One log of JSON, frames, Protobuf messages, text and bytes, decoded without knowing which is which."""
    log = inputs.raw(spark, sf_dir, mixed=True).unionByName(inputs.protobuf_log(spark, sf_dir))
    rows = to_records(log)
    return rows.select(
        "topic", "offset", "payload_format", "is_structured", "schema_id", json_text("payload", "$.tag_1").alias("tag_1")
    )


@query
def decode_plug_in(spark, sf_dir):
    """A decoder of one's own for the malformed values: the text before the comma, as an object."""
    broken = F.contains(F.col("value").cast("string"), F.lit("corrupted_field"))
    head = F.concat(F.substring_index(F.col("value").cast("string"), ",", 1), F.lit("}"))
    rows = decode(inputs.raw(spark, sf_dir), wire=False, extra=[("repaired", broken, F.try_parse_json(head))])
    return rows.groupBy("payload_format").agg(
        F.count(F.lit(1)).alias("records"), F.count(json_text("payload", "$.order_id")).alias("with_order")
    )


# Views


@query
def summary_view(spark, sf_dir):
    rows = views.summary_view(inputs.records(spark, sf_dir))
    return rows.select(
        *COORDINATES, "timestamp", "key", "format", "is_dlq", F.expr(CORRELATION).alias("correlation"), "payload"
    )


@query
def table_view(spark, sf_dir):
    return views.table_view(inputs.mixed_records(spark, sf_dir))


@query
def raw_view(spark, sf_dir):
    return views.raw_view(inputs.mixed_records(spark, sf_dir))


@query
def dlq_list_view(spark, sf_dir):
    return views.dlq_list_view(inputs.dead_letters(spark, sf_dir))


@query
def dlq_inspect_view(spark, sf_dir):
    return views.inspect_view(dlq.inspect(inputs.dead_letters(spark, sf_dir), 50))


@query
def flatten_payload(spark, sf_dir):
    return views.flatten_payload(inputs.records(spark, sf_dir)).select(
        "offset", "path", "node_type", "leaf_text"
    )


# Filters


@query
def filter_predicate(spark, sf_dir):
    wanted = (json_text("payload", "$.event_type") == "purchase") & (json_num("payload", "$.total_amount") > 30)
    return filters.filter_events(inputs.records(spark, sf_dir), wanted).select(*COORDINATES, "value")


@query
def filter_sql_predicate(spark, sf_dir):
    text = "try_variant_get(payload, '$.props.k', 'int') >= 50 AND key LIKE 'user_1%' AND topic = 'user.events'"
    return filters.filter_events(inputs.records(spark, sf_dir), text).select(*COORDINATES, "key")


@query
def filter_truthy(spark, sf_dir):
    return filters.filter_events(inputs.records(spark, sf_dir), json_truthy("payload", "$.props.k")).groupBy("topic").agg(
        F.count(F.lit(1)).alias("records")
    )


@query
def filter_value_fallback(spark, sf_dir):
    """Records of a session, which have a value but nothing decoded: a predicate sees the value parsed as JSON."""
    path = scratch_dir(spark, "session")
    sessions.write_session(inputs.records(spark, sf_dir), path)
    rows = read_session(spark, path).withColumn("payload", F.lit(None).cast("variant"))
    found = filters.filter_events(rows, json_num("payload", "$.total_amount") > 30)
    return found.select(*COORDINATES, "key", F.col("payload").isNull().alias("undecoded"))


@query
def filter_regex(spark, sf_dir):
    hits = filters.filter_events(inputs.records(spark, sf_dir), regex="timeout|user_7$|cust_12\"")
    return hits.select(*COORDINATES, "key")


@query
def filter_combined(spark, sf_dir):
    wanted = json_num("payload", "$.total_amount") < 20
    hits = filters.filter_events(inputs.records(spark, sf_dir), wanted, regex="corr-[0-9]*7$")
    return hits.select(*COORDINATES, "key")


@query
def keyword_search(spark, sf_dir):
    return filters.keyword_filter(inputs.records(spark, sf_dir), "NullPointer").select(*COORDINATES, "key")


@query
def dlq_only(spark, sf_dir):
    return filters.dlq_only(inputs.records(spark, sf_dir)).select(*COORDINATES, "error_message")


# Lag and counters


def _lag(spark, sf_dir):
    log = inputs.raw(spark, sf_dir)
    return lag.lag_by_partition(lag.offsets(log), inputs.committed_offsets(log))


@query
def lag_by_partition(spark, sf_dir):
    return _lag(spark, sf_dir)


@query
def lag_of_group(spark, sf_dir):
    log = inputs.raw(spark, sf_dir)
    return lag.lag_by_partition(lag.offsets(log), inputs.committed_offsets(log), "billing")


@query
def lag_without_group(spark, sf_dir):
    return lag.lag_by_partition(lag.offsets(inputs.raw(spark, sf_dir)))


@query
def lag_total(spark, sf_dir):
    asked = spark.createDataFrame([("user.events",), ("no.such.topic",)], "topic string")
    return lag.lag_total(_lag(spark, sf_dir), asked)


@query
def lag_meter(spark, sf_dir):
    return lag.lag_view(_lag(spark, sf_dir)).drop("log_end_offset", "current_offset")


@query
def lag_share(spark, sf_dir):
    shares = lag.lag_share(_lag(spark, sf_dir))
    return shares.select("group_id", "topic", "partition", F.round("lag_share", 6).alias("lag_share"))


@query
def status_counts(spark, sf_dir):
    return stats.status_counts(flag(inputs.raw(spark, sf_dir)))


@query
def throughput_1s(spark, sf_dir):
    return stats.throughput(flag(inputs.raw(spark, sf_dir)))


@query
def recent_events(spark, sf_dir):
    newest = to_records(limits.recent(flag(inputs.raw(spark, sf_dir)), 300), wire=False)
    return newest.select(*COORDINATES, "timestamp_ms", "key")


@query
def recent_dlq_diagnosed(spark, sf_dir):
    newest = dlq.diagnose(to_records(limits.recent(flag(inputs.raw(spark, sf_dir)), 100, dlq_only=True), wire=False))
    return newest.select(*COORDINATES, "failure_category", "exception_type")


# Dead letters


@query
def dlq_diagnose(spark, sf_dir):
    return dlq.diagnose(inputs.dead_letters(spark, sf_dir)).select(*COORDINATES, *dlq.DIAGNOSIS)


@query
def dlq_by_category(spark, sf_dir):
    return dlq.by_category(dlq.diagnose(inputs.dead_letters(spark, sf_dir)))


@query
def dlq_own_rules(spark, sf_dir):
    rules = (
        dlq.Rule("gateway", "Gateway", "The gateway failed.", "Wait."),
        dlq.Rule("null|id", "Data", "A value is missing or taken.", "Check the value."),
    )
    return dlq.by_category(dlq.diagnose(inputs.dead_letters(spark, sf_dir), rules))


@query
def dlq_source_link(spark, sf_dir):
    dead = dlq.diagnose(inputs.dead_letters(spark, sf_dir))
    return dlq.link_source(dead, inputs.raw(spark, sf_dir)).select(
        *COORDINATES, "original_offset", "source_value", "source_timestamp_ms"
    )


def _sent(plan: DataFrame) -> DataFrame:
    """A plan with its headers as scalars."""
    names = F.array_sort(F.transform("headers", lambda h: h["key"]))
    sent_from = F.filter("headers", lambda h: h["key"] == "x-redrive-source-offset")[0]["value"]
    return plan.select(
        F.col("topic").alias("target"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.array_join(names, ",").alias("header_names"),
        sent_from.cast("string").alias("sent_from"),
        "source_topic",
        "source_partition",
        "source_offset",
        "success",
        "error",
    )


@query
def redrive_plan(spark, sf_dir):
    return _sent(redrive.plan_redrive(inputs.dead_letters(spark, sf_dir)))


@query
def redrive_keep_headers(spark, sf_dir):
    return _sent(redrive.plan_redrive(inputs.dead_letters(spark, sf_dir), target="user.retry", strip=False))


@query
def redrive_patched(spark, sf_dir):
    dead = inputs.dead_letters(spark, sf_dir)
    broken = dlq.diagnose(dead).filter(filters.in_category("syntax"))
    patches = broken.select(*COORDINATES, F.concat(F.lit('{"fixed":'), F.col("offset"), F.lit("}")).alias("patched_payload"))
    return _sent(redrive.plan_redrive(redrive.with_patches(dead, patches), target="user.events"))


@query
def redrive_patch_file(spark, sf_dir):
    """Patches from a file of JSON lines, half of them objects and half of them strings."""
    dead = inputs.dead_letters(spark, sf_dir)
    broken = dlq.diagnose(dead).filter(filters.in_category("syntax"))
    line = """concat('{"topic":"', topic, '","partition":', partition, ',"offset":', offset, ',"patched_payload":',
        IF(offset % 2 = 0, concat('{"fixed":', offset, '}'), concat('"{\\\\"fixed\\\\":', offset, '}"')), '}')"""
    path = scratch_dir(spark, "patches")
    broken.select(F.expr(line)).write.text(path)
    patches = read_patches(spark, path)
    return _sent(redrive.plan_redrive(redrive.with_patches(dead, patches), target="user.events"))


@query
def redrive_publish(spark, sf_dir):
    """What a redrive sends: the rows of its plan that have a target."""
    path = scratch_dir(spark, "sent")
    publish.publish_to_files(redrive.plan_redrive(inputs.dead_letters(spark, sf_dir)), path)
    return _messages(spark.read.parquet(path))


@query
def redrive_without_sent(spark, sf_dir):
    dead = inputs.dead_letters(spark, sf_dir)
    ledger = dead.filter("offset % 2 = 0").select(*COORDINATES)
    return redrive.already_sent(dead, ledger).select(*COORDINATES)


@query
def redrive_batch_summary(spark, sf_dir):
    return redrive.redrive_batch(inputs.dead_letters(spark, sf_dir), dry_run=True)[1]


@query
def redrive_batch_category(spark, sf_dir):
    wanted = json_num("payload", "$.total_amount") > 10
    return redrive.redrive_batch(inputs.dead_letters(spark, sf_dir), category="Outage", predicate=wanted)[1]


@query
def redrive_batch_limit(spark, sf_dir):
    return redrive.redrive_batch(inputs.dead_letters(spark, sf_dir), category="failure", limit=50, dry_run=True)[1]


@query
def redrive_batch_plan(spark, sf_dir):
    plan = redrive.redrive_batch(inputs.dead_letters(spark, sf_dir), category="failure", limit=50, dry_run=True)[0]
    return plan.select(
        F.col("topic").alias("target"), "source_topic", "source_partition", "source_offset", "produced_partition", "produced_offset"
    )


# Traces


@query
def trace_one(spark, sf_dir):
    hops = trace.trace_hops(inputs.records(spark, sf_dir), "ORD_12")
    return hops.select("correlation_id", "step", *COORDINATES, "timestamp_ms", "event_type", "status", "latency_ms")


@query
def trace_hop_view(spark, sf_dir):
    return views.hop_view(trace.trace_hops(inputs.records(spark, sf_dir), "corr-77"))


@query
def trace_all_hops(spark, sf_dir):
    hops = trace.trace_all(inputs.records(spark, sf_dir), CORRELATION)
    return hops.select("correlation_id", "step", *COORDINATES, "status", "latency_ms")


@query
def trace_one_hot_key(spark, sf_dir):
    """Every record in one of three traces: what a dominating id does to the operator."""
    id_expr = "CASE WHEN offset % 3 = 0 THEN 'hot' ELSE concat('t', offset % 2) END"
    hops = trace.trace_all(inputs.records(spark, sf_dir), id_expr)
    return hops.select("correlation_id", "step", *COORDINATES, "latency_ms")


def _summary(summary: DataFrame) -> DataFrame:
    return summary.withColumn("topics", F.array_join("topics", " > "))


@query
def trace_summary(spark, sf_dir):
    rows = inputs.records(spark, sf_dir).withColumn("correlation_id", F.expr(CORRELATION))
    return _summary(trace.trace_summary(rows))


@query
def trace_order_lifecycle(spark, sf_dir):
    rows = inputs.order_lifecycle(spark, sf_dir).withColumn("correlation_id", F.col("key"))
    return _summary(trace.trace_summary(rows))


@query
def trace_order_hops(spark, sf_dir):
    hops = trace.trace_all(inputs.order_lifecycle(spark, sf_dir), "key")
    return hops.select("correlation_id", "step", "topic", "offset", "event_type", "latency_ms")


def _wanted_ids(spark, sf_dir):
    """An id for every event above 40: orders of different length, some of which contain others."""
    return inputs.events(spark, sf_dir).filter("value > 40").select(
        F.expr("concat('ORD_', event_id DIV 5)").alias("correlation_id")
    ).distinct()


@query
def trace_many(spark, sf_dir):
    hops = trace.trace_many(inputs.records(spark, sf_dir), _wanted_ids(spark, sf_dir))
    return hops.select("correlation_id", "step", *COORDINATES, "latency_ms")


@query
def trace_many_exact(spark, sf_dir):
    hops = trace.trace_many(inputs.records(spark, sf_dir), _wanted_ids(spark, sf_dir), exact=True)
    return hops.select("correlation_id", "step", *COORDINATES, "latency_ms")


# Differences


@query
def diff_items(spark, sf_dir):
    return diff.diff_payloads(inputs.payload_pairs(spark, sf_dir))


@query
def diff_summary(spark, sf_dir):
    return diff.diff_summary(inputs.payload_pairs(spark, sf_dir))


@query
def diff_dlq_source(spark, sf_dir):
    """Each dead letter against the record it came from, where that exists."""
    dead = dlq.diagnose(inputs.dead_letters(spark, sf_dir))
    linked = dlq.link_source(dead, inputs.raw(spark, sf_dir)).filter("source_value IS NOT NULL")
    pairs = linked.select(F.col("offset").alias("pair_id"), F.col("value").alias("a"), F.col("source_value").alias("b"))
    return diff.diff_payloads(pairs).select("pair_id", "path", "diff_type")


# Sessions, replay, export, produce


@query
def replay_plan(spark, sf_dir):
    rows = inputs.records(spark, sf_dir)
    session = sessions.session_rows(rows, F.col("timestamp_ms"))
    plan = publish.replay_plan(session, target="user.replay", speed=100.0, source_file="day.lens")
    return plan.select(
        "topic",
        "partition",
        "offset",
        "key",
        F.expr("headers['x-replay-source-file']").alias("source_file"),
        F.expr("size(headers)").cast("bigint").alias("header_count"),
        F.round("delay_s", 5).alias("delay_s"),
        F.round("replay_at_s", 5).alias("replay_at_s"),
        "sequence",
        "published",
    )


def _messages(sent: DataFrame) -> DataFrame:
    """Published messages as text, with the number of their headers."""
    return sent.select(
        "topic",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.size("headers").cast("bigint").alias("header_count"),
    )


@query
def publish_records(spark, sf_dir):
    path = scratch_dir(spark, "published")
    publish.publish_to_files(inputs.records(spark, sf_dir).withColumn("topic", F.lit("user.copy")), path)
    return _messages(spark.read.parquet(path))


@query
def session_stamped(spark, sf_dir):
    """A session recorded now: each line has the time at which it was recorded."""
    path = scratch_dir(spark, "session")
    begun = spark.range(1).select(sessions.now_ms()).first()[0]
    sessions.write_session(inputs.records(spark, sf_dir), path)
    stamped = F.col("time_recorded_ms").between(F.lit(begun), sessions.now_ms())
    return read_session(spark, path).select(*COORDINATES, stamped.alias("stamped"))


@query
def session_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "session")
    sessions.write_session(inputs.records(spark, sf_dir), path, recorded_ms=F.col("timestamp_ms"))
    return read_session(spark, path).select(
        "time_recorded_ms", *COORDINATES, "timestamp", "key", "value", F.expr(CORRELATION).alias("correlation"),
        "payload_format", "is_dlq",
    )


@query
def export_csv_rows(spark, sf_dir):
    path = scratch_dir(spark, "export")
    export.export(inputs.records(spark, sf_dir), path, "csv", dlq_only=True)
    fields = "Topic string, Partition int, Offset bigint, Key string, Format string, Timestamp bigint, Is_DLQ boolean, Payload string"
    return spark.read.schema(fields).option("header", "true").option("escape", '"').csv(path)


@query
def export_json_lines(spark, sf_dir):
    path = scratch_dir(spark, "export")
    export.export(inputs.records(spark, sf_dir), path, "ndjson")
    fields = "topic string, partition int, offset bigint, timestamp bigint, key string, format string, is_dlq boolean"
    return spark.read.schema(fields).json(path)


@query
def export_json_array(spark, sf_dir):
    path = scratch_dir(spark, "export")
    export.export(inputs.records(spark, sf_dir), path, "json")
    line = F.col("value")
    return spark.read.text(path).select(
        F.when(line.isin("[", "]"), line).otherwise(F.substring(line, 1, 1)).alias("mark")
    ).groupBy("mark").agg(F.count(F.lit(1)).alias("lines"))


@query
def produce_template(spark, sf_dir):
    templates = inputs.events(spark, sf_dir).filter("event_type = 'signup'").select(
        F.lit("user.test").alias("topic"),
        F.expr("concat('{\"id\":', event_id, '}')").alias("value"),
        F.expr("concat('user_', user_id)").alias("key"),
        F.expr("concat('x-a: ', event_id, ' ,x-url:http://h:80,bare,x-a:', user_id)").alias("header_text"),
    )
    rows = publish.expand_messages(templates, 3)
    messages = publish.as_messages(rows)
    return messages.select(
        "topic",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.array_join(
            F.array_sort(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string")))), ";"
        ).alias("headers"),
    )


# Streams: run to the end of the present data, then compared with the batch result


def _live_raw(spark, sf_dir):
    log = inputs.prepare(spark).readStream.schema(inputs.EVENT_FIELDS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return inputs.raw_log(log)


def _live(spark, sf_dir):
    return to_records(_live_raw(spark, sf_dir), wire=False)


def _appended(spark, frame: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(spark, name)
    live.append_to(frame, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/rows")


@query
def stream_tail(spark, sf_dir):
    wanted = json_num("payload", "$.total_amount") > 60
    return _appended(spark, live.tail(_live(spark, sf_dir), wanted), "tail")


@query
def stream_alerts(spark, sf_dir):
    return _appended(spark, live.dlq_alerts(_live(spark, sf_dir)), "alerts").select("offset", "alert")


def _in_parts(spark, sf_dir, name: str, parts: list[str], run: Callable[[DataFrame, str, str], StreamingQuery]) -> str:
    """Run a stream once for each part of the events, as they are added to its folder: each run goes on from the checkpoint.

    Returns the folder of the result.
    """
    path = scratch_dir(spark, name)
    for wanted in parts:
        inputs.events(spark, sf_dir).filter(wanted).write.mode("append").parquet(f"{path}/events")
        log = inputs.raw_log(spark.readStream.schema(inputs.EVENT_FIELDS).parquet(f"{path}/events"))
        run(log, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return f"{path}/rows"


#: Parts in which traces and seconds come late and in pieces.
LATE_PARTS = [f"event_id % 5 = {k}" for k in (3, 0, 4, 1, 2)]


@query
def stream_throughput(spark, sf_dir):
    def run(log, rows, checkpoint):
        return live.keep_throughput(flag(log), rows, checkpoint, every=2)

    return live.read_throughput(spark, _in_parts(spark, sf_dir, "throughput", LATE_PARTS, run))


@query
def stream_trace(spark, sf_dir):
    """Four micro-batches that follow each other in time."""
    ends = inputs.events(spark, sf_dir).agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    cuts = [] if ends.first is None else [ends.first + (ends.last - ends.first) * k / 4 for k in (1, 2, 3)]
    quarter = " + ".join(["0", *[f"IF(ts >= TIMESTAMP_NTZ'{c}', 1, 0)" for c in cuts]])
    parts = [f"coalesce({quarter}, 0) = {k}" for k in range(4)]

    def run(log, rows, checkpoint):
        return latency.keep_hops(to_records(log, wire=False), F.expr(CORRELATION), rows, checkpoint, every=2)

    hops = latency.read_hops(spark, _in_parts(spark, sf_dir, "trace", parts, run))
    return hops.select("correlation_id", "step", *COORDINATES, "status", "latency_ms")


@query
def stream_trace_summary(spark, sf_dir):
    def run(log, rows, checkpoint):
        return live.keep_trace_summary(to_records(log, wire=False), F.expr(CORRELATION), rows, checkpoint, every=2)

    return _summary(live.read_trace_summary(spark, _in_parts(spark, sf_dir, "trace-summary", LATE_PARTS, run)))


@query
def stream_recent(spark, sf_dir):
    path = scratch_dir(spark, "recent")
    live.keep_recent(_live(spark, sf_dir), f"{path}/rows", f"{path}/checkpoint", 300).awaitTermination()
    return live.read_recent(spark, f"{path}/rows").select(*COORDINATES, "timestamp_ms", "key")


@query
def stream_session(spark, sf_dir):
    path = scratch_dir(spark, "capture")
    live.record_stream(_live(spark, sf_dir), f"{path}/session", f"{path}/checkpoint", available_now=True)
    return read_session(spark, f"{path}/session").select(*COORDINATES, "timestamp", "key", "value", "is_dlq")


@query
def stream_lag(spark, sf_dir):
    path = scratch_dir(spark, "lag")

    def committed(session):
        return inputs.committed_offsets(inputs.raw(session, sf_dir))

    def write(rows, number):
        rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch-{number:09d}")

    live.refresh_lag(_live(spark, sf_dir), committed, write, f"{path}/checkpoint", every=None).awaitTermination()
    rows = live.latest(spark, f"{path}/rows", ["group_id", "topic", "partition"])
    return rows.select("group_id", "topic", "partition", "log_end_offset", "current_offset", "lag")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters per failure cause: read, normalise, decode, diagnose, count."""
    records = inputs.records(spark, sf_dir)
    return dlq.by_category(dlq.diagnose(filters.dlq_only(records))).orderBy("failure_category")
