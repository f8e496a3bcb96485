"""RAW records to decoded, normalised RECORD rows.

Nothing is shuffled. Only values marked as Protobuf go through Python, in Arrow batches; every other row is a NULL in
that batch. The decoded columns leave through a one-row generator: Catalyst pushes filters on topic, partition, offset,
time and headers below it, down to the scan, and keeps filters on the payload above it. Without it such a
filter would be pushed down with a copy of the whole decoding for each reference to the payload.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwise.functions.payload import framed_array, framed_value, looks_bracketed
from topicwise.functions.text import bytes_text, header, header_map, non_empty
from topicwise.operators.protobuf import ProtoSpec, message_json
from topicwise.schemas import RAW, RECORD
from topicwise.session import prepare

# Format names, header names and the wire-format tag that results must carry.
DLQ_MARKER_HEADERS = ("x-exception-message", "x-original-topic", "deadletter.reason")
ERROR_HEADERS = ("x-exception-message", "deadletter.reason")
BINARY_FRAME_TAG = "confluent-avro"

Extra = tuple[str, Column, Column]


def decode(
    raw: DataFrame,
    proto: ProtoSpec | None = None,
    wire: bool = True,
    extra: Sequence[Extra] = (),
) -> DataFrame:
    """Detect the format of ``value`` and decode it.

    Adds ``header_text`` (map), ``payload`` (VARIANT object or array, else NULL), ``payload_format``,
    ``is_structured``, ``schema_id`` and ``decode_error``. Order of detection: NULL; content type naming
    protobuf; schema-id frame (0x00 + 4 bytes); JSON object or array; ``extra`` decoders; Protobuf with the
    given schema; empty; UTF-8 text; bytes.

    ``wire=False`` leaves Protobuf values undecoded when no schema is given, so that the plan has no Python stage.
    ``extra`` holds ``(format name, condition, VARIANT expression)`` tuples tried before the text fallback.
    """
    prepare(raw.sparkSession)
    value = F.col("value")
    size = F.octet_length(value)
    content_type = F.coalesce(header("header_text", "content-type", "Content-Type"), F.lit(""))

    df = raw.withColumn("header_text", header_map("headers"))
    df = df.withColumns(
        {
            "_by_type": F.contains(F.lower(content_type), F.lit("protobuf")) & (size > 0),
            "_framed": F.coalesce((size >= 5) & (F.substring(value, 1, 1) == F.lit(b"\x00")), F.lit(False)),
        }
    )
    df = df.withColumn("_by_type", F.coalesce("_by_type", F.lit(False)))
    df = df.withColumns(
        {
            "_body": F.when(F.col("_framed"), F.expr("substring(value, 6)")).otherwise(value).cast("string"),
            "schema_id": F.when(
                F.col("_framed") & ~F.col("_by_type"),
                F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("bigint"),
            ),
        }
    )
    body = F.col("_body")
    rest = F.expr(r"substring(ltrim(' \t\n\r', _body), 2)")
    body_is_object = F.startswith(F.expr(r"ltrim(' \t\n\r', _body)"), F.lit("{"))
    id_field = F.concat(F.lit('{"_schema_id":'), F.col("schema_id").cast("string"))
    comma = F.when(F.expr(r"substring(ltrim(' \t\n\r', substring(ltrim(' \t\n\r', _body), 2)), 1, 1) = '}'"), "").otherwise(",")
    doc = (
        F.when(F.col("_by_type") | ~F.is_valid_utf8(body), F.lit(None).cast("string"))
        .when(F.col("_framed") & body_is_object, F.concat(id_field, comma, rest))
        .when(F.col("_framed") | looks_bracketed(body), body)
    )
    df = df.withColumn("_doc", doc)
    df = df.withColumn("_parsed", framed_value(framed_array("_doc"), "_doc"))

    message = F.lit(None).cast("struct<json:string,error:string>")
    if proto is not None:
        wanted = F.col("_by_type") | (~F.col("_framed") & F.col("_parsed").isNull() & (size > 0))
        message = message_json(proto)(F.when(wanted, value))
    elif wire:
        message = message_json(None)(F.when(F.col("_by_type"), value))
    df = df.withColumn("_message", message)

    parsed, msg = F.col("_parsed"), F.col("_message")
    is_frame, by_type = F.col("_framed"), F.col("_by_type")
    by_schema = msg["json"].isNotNull() if proto is not None else F.lit(False)
    wrapped = F.try_parse_json(F.concat(id_field, F.lit(',"content":'), F.to_json(parsed), F.lit("}")))
    as_hex = F.try_parse_json(
        F.concat(
            id_field,
            F.lit(f',"_wire_format":"{BINARY_FRAME_TAG}","payload_hex":"'),
            F.lower(F.hex(F.expr("substring(value, 6)"))),
            F.lit('","payload_length_bytes":'),
            (size - 5).cast("string"),
            F.lit("}"),
        )
    )

    fmt = F.when(value.isNull(), "null").when(by_type, "protobuf").when(is_frame, "avro").when(parsed.isNotNull(), "json")
    payload = (
        F.when(by_type, F.try_parse_json(msg["json"]))
        .when(is_frame & parsed.isNotNull() & body_is_object, parsed)
        .when(is_frame & parsed.isNotNull(), wrapped)
        .when(is_frame, as_hex)
        .when(parsed.isNotNull(), parsed)
    )
    for name, condition, expression in extra:
        fmt = fmt.when(condition, F.lit(name))
        payload = payload.when(condition & value.isNotNull(), expression)
    fmt = (
        fmt.when(by_schema, "protobuf")
        .when(size == 0, "raw")
        .when(F.is_valid_utf8(body), "text")
        .otherwise("binary")
    )
    payload = payload.when(by_schema, F.try_parse_json(msg["json"]))
    decoded = F.struct(
        payload.alias("payload"),
        fmt.alias("payload_format"),
        payload.isNotNull().alias("is_structured"),
        F.col("schema_id"),
    )
    # The error stands beside the generator: what reads only the error or the headers is not tied to the payload.
    error = F.when(by_type, msg["error"]).alias("decode_error")
    return df.select(*raw.columns, "header_text", error, F.inline(F.array(decoded)))


def flag(raw: DataFrame) -> DataFrame:
    """RAW with ``timestamp_ms`` and ``is_dlq``, which need no decoding: what counts, filters or cuts by them comes before
    :func:`to_records`, which takes the result like RAW."""
    prepare(raw.sparkSession)
    return raw.withColumns({"timestamp_ms": F.unix_millis("timestamp"), "is_dlq": _is_dlq(header_map("headers"))})


def _is_dlq(headers: Column) -> Column:
    marked = F.arrays_overlap(F.map_keys(headers), F.array(*[F.lit(n) for n in DLQ_MARKER_HEADERS]))
    return F.contains(F.lower("topic"), F.lit("dlq")) | marked


def to_records(
    raw: DataFrame,
    proto: ProtoSpec | None = None,
    wire: bool = True,
    extra: Sequence[Extra] = (),
) -> DataFrame:
    """RAW to RECORD: decode the value, turn key, value and headers into text, flag dead letters."""
    df = decode(raw.select(*RAW.names), proto, wire, extra)
    headers = F.col("header_text")
    return df.select(
        "topic",
        "partition",
        "offset",
        F.unix_millis("timestamp").alias("timestamp_ms"),
        bytes_text(non_empty("key")).alias("key"),
        bytes_text(non_empty("value")).alias("value"),
        F.col("key").alias("raw_key"),
        F.col("value").alias("raw_value"),
        headers.alias("headers"),
        "payload",
        "payload_format",
        "is_structured",
        "schema_id",
        "decode_error",
        _is_dlq(headers).alias("is_dlq"),
        F.coalesce(header(headers, *ERROR_HEADERS), F.col("decode_error")).alias("error_message"),
    ).select(*RECORD.names)


#: Largest registry, in rows and in characters of schema text, that is sent whole to every task.
BROADCAST_SCHEMAS = 50_000
BROADCAST_SCHEMA_CHARS = 16_000_000


def attach_schema(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``schema_definition`` and ``schema_type`` (default AVRO) of each framed record.

    A small job measures the registry. Up to the limits above it is broadcast and the log is not shuffled. Beyond, only framed
    records are, and adaptive execution splits a dominating schema id.
    """
    entries = schemas.select(
        F.col("schema_id").alias("_entry"),
        F.col("schema").alias("schema_definition"),
        F.coalesce("schema_type", F.lit("AVRO")).alias("schema_type"),
    )
    chars = F.coalesce(F.sum(F.length("schema_definition")), F.lit(0))
    size = entries.agg(F.count(F.lit(1)).alias("n"), chars.alias("chars")).first()
    same = F.col("schema_id") == F.col("_entry")
    if size.n <= BROADCAST_SCHEMAS and size.chars <= BROADCAST_SCHEMA_CHARS:
        return records.join(F.broadcast(entries), same, "left").drop("_entry")
    framed = records.filter("schema_id IS NOT NULL").join(entries, same, "left").drop("_entry")
    none = F.lit(None).cast("string")
    plain = records.filter("schema_id IS NULL").withColumns({"schema_definition": none, "schema_type": none})
    return framed.unionByName(plain)
