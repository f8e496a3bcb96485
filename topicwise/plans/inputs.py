"""Record logs derived from the given tables. Plain projections: no shuffle, and they also work on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwise.operators.decode import to_records
from topicwise.operators.filters import dlq_only
from topicwise.operators.protobuf import ProtoSpec
from topicwise.schemas import RAW, SCHEMA_ENTRY
from topicwise.session import prepare

EVENT_FIELDS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

TOPIC = """CASE event_type WHEN 'error' THEN 'user.events.dlq' WHEN 'purchase' THEN 'payment.events'
           ELSE 'user.events' END"""
TEXT = """CASE WHEN event_type = 'error' AND event_id % 7 = 0
          THEN concat('{"order_id":"ord_', event_id DIV 5, '", corrupted_field: }')
          ELSE concat('{"event_id":"evt_', event_id, '","order_id":"ord_', event_id DIV 5, '","event_type":"', event_type,
                      '","customer_id":"cust_', user_id, '","total_amount":', CAST(value AS DECIMAL(12,2)),
                      ',"props":', props, '}') END"""
HEADERS = """filter(array(
    named_struct('key', 'x-correlation-id', 'value', CAST(concat('corr-', event_id DIV 5) AS BINARY)),
    named_struct('key', 'x-exception-message', 'value', CAST(CASE WHEN event_type = 'error' THEN CASE event_id % 7
        WHEN 0 THEN 'JsonParseException: Unexpected character'
        WHEN 1 THEN 'ValidationException: missing required field'
        WHEN 2 THEN 'DecodeError: Truncated message'
        WHEN 3 THEN 'TimeoutException: gateway 504'
        WHEN 4 THEN 'AlreadyExists: Duplicate id'
        WHEN 5 THEN 'java.lang.NullPointerException: null'
        ELSE 'Boom: unknown' END END AS BINARY)),
    named_struct('key', 'x-exception-stacktrace', 'value', CAST(CASE WHEN event_type = 'error' AND event_id % 7 = 6
        THEN 'java.io.IOException: disk full' END AS BINARY)),
    named_struct('key', 'x-original-topic', 'value', CAST(CASE WHEN event_type = 'error' AND event_id % 11 <> 0
        THEN 'user.events' END AS BINARY)),
    named_struct('key', 'x-original-partition', 'value', CAST(CASE WHEN event_type = 'error' AND event_id % 11 <> 0
        THEN CAST(user_id % 4 AS STRING) END AS BINARY)),
    named_struct('key', 'x-original-offset', 'value', CAST(CASE WHEN event_type = 'error' AND event_id % 11 <> 0
        THEN CAST(event_id - 1 AS STRING) END AS BINARY))
), h -> h.value IS NOT NULL)"""
# Values that are not plain JSON text: NULL, not UTF-8, empty, framed with a JSON or a binary body.
MIXED = """CASE WHEN event_id % 17 = 0 THEN CAST(NULL AS BINARY)
           WHEN event_id % 19 = 0 THEN concat(X'FF00', v)
           WHEN event_id % 23 = 0 THEN X''
           WHEN event_id % 26 = 0 THEN concat(X'00000000', unhex(hex(101 + event_id % 3)), v)
           WHEN event_id % 13 = 0 THEN concat(X'00000000', unhex(hex(101 + event_id % 3)), X'FF', v)
           ELSE v END"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/events.parquet")


def raw_log(source: DataFrame, mixed: bool = False) -> DataFrame:
    """The events as RAW Kafka records. The offset is the event id: increasing, with gaps, as in a compacted log."""
    v = "CAST(%s AS BINARY)" % TEXT
    df = source.withColumn("v", F.expr(v))
    return df.select(
        F.expr("CAST(concat('user_', user_id) AS BINARY)").alias("key"),
        (F.expr(MIXED) if mixed else F.col("v")).alias("value"),
        F.expr(TOPIC).alias("topic"),
        F.expr("CAST(user_id % 4 AS INT)").alias("partition"),
        F.col("event_id").alias("offset"),
        F.expr("CAST(ts AS TIMESTAMP)").alias("timestamp"),
        F.lit(0).alias("timestampType"),
        F.expr(HEADERS).alias("headers"),
    ).select(*RAW.names)


def raw(spark: SparkSession, sf_dir: str, mixed: bool = False) -> DataFrame:
    return raw_log(events(spark, sf_dir), mixed)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded records. This log has no Protobuf, so decoding stays in the JVM."""
    return to_records(raw(spark, sf_dir), wire=False)


def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_records(raw(spark, sf_dir, mixed=True), wire=False)


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters among all records."""
    return dlq_only(records(spark, sf_dir))


def schema_registry(spark: SparkSession) -> DataFrame:
    rows = [(101, '{"type":"record","name":"Order"}', "AVRO"), (102, '{"type":"object"}', "JSON"), (777, "unused", None)]
    return spark.createDataFrame(rows, SCHEMA_ENTRY)


def order_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their shipments as records of two topics, keyed by order."""
    prepare(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.lit("order.events").alias("topic"),
        F.col("o_orderkey").alias("order"),
        F.col("o_orderkey").alias("offset"),
        F.col("o_orderdate").alias("at"),
        F.expr("o_orderstatus = 'F'").alias("is_dlq"),
        F.lit("OrderCreated").alias("type"),
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.lit("shipment.events").alias("topic"),
        F.col("l_orderkey").alias("order"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("offset"),
        F.col("l_shipdate").alias("at"),
        F.lit(False).alias("is_dlq"),
        F.lit("Shipped").alias("type"),
    )
    both = orders.unionByName(lines)
    return both.select(
        "topic",
        F.expr("CAST(`order` % 4 AS INT)").alias("partition"),
        "offset",
        F.expr("unix_millis(CAST(at AS TIMESTAMP))").alias("timestamp_ms"),
        F.expr("concat('order_', `order`)").alias("key"),
        F.expr("concat('{\"event_type\":\"', type, '\"}')").alias("value"),
        F.expr("try_parse_json(concat('{\"event_type\":\"', type, '\"}'))").alias("payload"),
        F.expr("CAST(map() AS MAP<STRING,STRING>)").alias("headers"),
        "is_dlq",
        F.lit(None).cast("string").alias("error_message"),
    )


def committed_offsets(raw_records: DataFrame) -> DataFrame:
    """Two groups: one behind by 60 per partition number and never on partition 3, one ahead of the log."""
    ends = raw_records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end"))
    behind = ends.filter("partition <> 3").select(
        F.lit("billing").alias("group_id"), "topic", "partition", F.expr("`end` - 60 * partition").alias("committed_offset")
    )
    ahead = ends.filter("topic = 'user.events'").select(
        F.lit("audit").alias("group_id"), "topic", "partition", F.expr("`end` + 5 - 4 * partition").alias("committed_offset")
    )
    return behind.unionByName(ahead)


def protobuf_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as Protobuf messages, written field by field; every ninth is cut off in the middle."""
    text_field = "concat(unhex('%s'), unhex(lpad(hex(octet_length(%s)), 2, '0')), %s)"
    number = "128 + event_id % 1000"
    varint = f"concat(unhex(hex(128 + ({number}) % 128)), unhex(lpad(hex(({number}) DIV 128), 2, '0')))"
    fields = [
        text_field % ("0A", "i", "i"),
        text_field % ("12", "o", "o"),
        text_field % ("1A", "c", "c"),
        f"concat(X'38', {varint})",
    ]
    df = events(spark, sf_dir).filter("event_type = 'purchase'").withColumns(
        {
            "i": F.expr("CAST(concat('evt_', event_id) AS BINARY)"),
            "o": F.expr("CAST(concat('ord_', event_id DIV 5) AS BINARY)"),
            "c": F.expr("CAST(concat('cust_', user_id) AS BINARY)"),
        }
    )
    message = f"concat({', '.join(fields)})"
    return df.select(
        F.expr("CAST(concat('user_', user_id) AS BINARY)").alias("key"),
        F.expr(f"CASE WHEN event_id % 9 = 0 THEN substring({message}, 1, 4) ELSE {message} END").alias("value"),
        F.lit("payment.proto").alias("topic"),
        F.expr("CAST(user_id % 4 AS INT)").alias("partition"),
        F.col("event_id").alias("offset"),
        F.expr("CAST(ts AS TIMESTAMP)").alias("timestamp"),
        F.lit(0).alias("timestampType"),
        F.expr("array(named_struct('key', 'content-type', 'value', CAST('application/x-protobuf' AS BINARY)))").alias("headers"),
    )


def order_message() -> ProtoSpec:
    """Descriptor of the messages of :func:`protobuf_log`."""
    from google.protobuf import descriptor_pb2

    file = descriptor_pb2.FileDescriptorProto(name="orders.proto", package="shop", syntax="proto3")
    message = file.message_type.add(name="OrderCreated")
    kind = descriptor_pb2.FieldDescriptorProto
    texts = {1: "event_id", 2: "order_id", 3: "customer_id", 4: "currency"}
    for number, name in texts.items():
        message.field.add(name=name, number=number, type=kind.TYPE_STRING, label=kind.LABEL_OPTIONAL)
    message.field.add(name="sequence_number", number=7, type=kind.TYPE_INT64, label=kind.LABEL_OPTIONAL)
    return ProtoSpec(descriptor_pb2.FileDescriptorSet(file=[file]).SerializeToString(), "OrderCreated")


def payload_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's payload next to that of the same event with another type, amount and nested properties.

    Both sides come from one row, so the pairs need no join.
    """
    left = """concat('{"event_type":"', event_type, '","total":', CAST(value AS DECIMAL(12,2)), ',"props":', props,
                     CASE WHEN event_id % 3 = 0 THEN ',"obsolete":true' ELSE '' END, ',"tags":[1,2]}')"""
    right = """concat('{"event_type":"', CASE WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END,
                      '","total":', CASE WHEN event_id % 6 = 0 THEN CAST(value AS DECIMAL(12,2)) + 1
                                         ELSE CAST(value AS DECIMAL(12,2)) END,
                      ',"props":{"k":', event_id % 90, CASE WHEN event_id % 5 = 0 THEN ',"note":{"by":"ops"}' ELSE '' END,
                      '},"tags":[1,', CASE WHEN event_id % 8 = 0 THEN '3' ELSE '2' END, ']}')"""
    return events(spark, sf_dir).select(F.col("event_id").alias("pair_id"), F.expr(left).alias("a"), F.expr(right).alias("b"))
