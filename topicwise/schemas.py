"""Column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# What Spark's Kafka source yields with includeHeaders=true. A topic stored as Parquet has the same shape.
RAW = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
            ),
        ),
    ]
)

# A normalised, decoded record.
RECORD = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("raw_key", T.BinaryType()),
        T.StructField("raw_value", T.BinaryType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.VariantType()),
        T.StructField("payload_format", T.StringType()),
        T.StructField("is_structured", T.BooleanType()),
        T.StructField("schema_id", T.LongType()),
        T.StructField("decode_error", T.StringType()),
        T.StructField("is_dlq", T.BooleanType()),
        T.StructField("error_message", T.StringType()),
    ]
)

# One line of a recorded session (JSON lines).
SESSION = T.StructType(
    [
        T.StructField("time_recorded_ms", T.LongType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload_format", T.StringType()),
        T.StructField("is_dlq", T.BooleanType()),
    ]
)

# Registry entries joined on the schema id of a framed value.
SCHEMA_ENTRY = T.StructType(
    [
        T.StructField("schema_id", T.LongType()),
        T.StructField("schema", T.StringType()),
        T.StructField("schema_type", T.StringType()),
    ]
)
