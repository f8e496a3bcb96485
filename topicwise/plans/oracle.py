"""The results of the queries stated in DuckDB SQL over the same tables."""

from __future__ import annotations

REC = """
rec AS (
  SELECT event_id, user_id, event_type, "value" AS amount, props,
    CASE event_type WHEN 'error' THEN 'user.events.dlq' WHEN 'purchase' THEN 'payment.events' ELSE 'user.events' END AS topic,
    CAST(user_id % 4 AS INTEGER) AS "partition",
    event_id AS "offset",
    epoch_us(ts) // 1000 AS timestamp_ms,
    'user_' || user_id AS key,
    CASE WHEN event_type = 'error' AND event_id % 7 = 0
      THEN '{"order_id":"ord_' || (event_id // 5) || '", corrupted_field: }'
      ELSE '{"event_id":"evt_' || event_id || '","order_id":"ord_' || (event_id // 5) || '","event_type":"' || event_type
        || '","customer_id":"cust_' || user_id || '","total_amount":' || CAST(CAST("value" AS DECIMAL(12,2)) AS VARCHAR)
        || ',"props":' || props || '}' END AS value,
    'corr-' || (event_id // 5) AS corr,
    CASE WHEN event_type = 'error' THEN CASE event_id % 7
      WHEN 0 THEN 'JsonParseException: Unexpected character'
      WHEN 1 THEN 'ValidationException: missing required field'
      WHEN 2 THEN 'DecodeError: Truncated message'
      WHEN 3 THEN 'TimeoutException: gateway 504'
      WHEN 4 THEN 'AlreadyExists: Duplicate id'
      WHEN 5 THEN 'java.lang.NullPointerException: null'
      ELSE 'Boom: unknown' END END AS exc_msg,
    CASE WHEN event_type = 'error' AND event_id % 7 = 6 THEN 'java.io.IOException: disk full' END AS stack,
    CASE WHEN event_type = 'error' AND event_id % 11 <> 0 THEN 'user.events' END AS orig_topic,
    CASE WHEN event_type = 'error' AND event_id % 11 <> 0 THEN user_id % 4 END AS orig_partition,
    CASE WHEN event_type = 'error' AND event_id % 11 <> 0 THEN event_id - 1 END AS orig_offset,
    event_type = 'error' AS is_dlq
  FROM events
)"""

# Parsed payload fields; NULL for the malformed values. ``text`` is the payload as compact JSON with sorted keys.
DOC = (
    REC
    + """,
doc AS (
  SELECT *, json_valid(value) AS ok,
    CASE WHEN json_valid(value) THEN 'json' ELSE 'text' END AS format,
    CASE WHEN json_valid(value) THEN CAST(json_extract_string(value, '$.total_amount') AS DOUBLE) END AS total,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.order_id') END AS order_id,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.event_type') END AS doc_type,
    CASE WHEN json_valid(value) THEN CAST(json_extract_string(value, '$.props.k') AS INTEGER) END AS k,
    rtrim(rtrim(CAST(CAST(amount AS DECIMAL(12,2)) AS VARCHAR), '0'), '.') AS amount_text
  FROM rec
),
log AS (
  SELECT *, CASE WHEN ok THEN '{"customer_id":"cust_' || user_id || '","event_id":"evt_' || event_id || '","event_type":"'
      || event_type || '","order_id":"' || order_id || '","props":{"k":' || k || '},"total_amount":' || amount_text || '}'
    ELSE value END AS text
  FROM doc
)"""
)

# The log with values that are not plain JSON text, as bytes.
MIXED = (
    REC
    + """,
bytes AS (
  SELECT *,
    CASE WHEN event_id % 17 = 0 THEN NULL
      WHEN event_id % 19 = 0 THEN unhex('FF00') || encode(value)
      WHEN event_id % 23 = 0 THEN encode('')
      WHEN event_id % 26 = 0 THEN unhex('00000000' || hex(101 + event_id % 3)) || encode(value)
      WHEN event_id % 13 = 0 THEN unhex('00000000' || hex(101 + event_id % 3)) || unhex('FF') || encode(value)
      ELSE encode(value) END AS b
  FROM rec
),
shape AS (
  SELECT *, coalesce(octet_length(b) >= 5 AND substr(hex(b), 1, 2) = '00', false) AS framed,
    try(decode(b)) AS whole, CASE WHEN octet_length(b) >= 5 THEN try(decode(unhex(substr(hex(b), 11)))) END AS body
  FROM bytes
),
mixed AS (
  SELECT *,
    CASE WHEN octet_length(b) = 0 THEN NULL WHEN whole IS NULL THEN '0x' || lower(hex(b)) ELSE whole END AS text_value,
    CASE WHEN framed THEN CAST('0x' || substr(hex(b), 3, 8) AS BIGINT) END AS schema_id,
    CASE WHEN b IS NULL THEN 'null' WHEN framed THEN 'avro' WHEN octet_length(b) = 0 THEN 'raw'
      WHEN whole IS NULL THEN 'binary' WHEN json_valid(whole) THEN 'json' ELSE 'text' END AS format,
    CASE WHEN framed AND coalesce(json_valid(body), false) THEN 'json' WHEN framed THEN 'hex' END AS frame_kind
  FROM shape
)"""
)

DIAGNOSED = (
    REC
    + """,
dead AS (SELECT *, exc_msg || chr(10) || coalesce(stack, '') AS txt FROM rec WHERE is_dlq),
ruled AS (
  SELECT *, CASE
    WHEN regexp_matches(txt, 'JsonParse|Unexpected character|Expecting value|JSONDecodeError|invalid json', 'i') THEN 1
    WHEN regexp_matches(txt, 'ValidationException|ConstraintViolation|missing required|pattern mismatch|invalid field', 'i') THEN 2
    WHEN regexp_matches(txt, 'DecodeError|Truncated message|wire type|invalid tag|protobuf', 'i') THEN 3
    WHEN regexp_matches(txt, 'TimeoutException|ConnectException|ConnectionRefused|ConnectionError|SocketTimeout|503|504', 'i') THEN 4
    WHEN regexp_matches(txt, 'Duplicate|AlreadyExists|ConflictException|OptimisticLock', 'i') THEN 5
    WHEN regexp_matches(txt, 'NullPointerException|AttributeError|KeyError|IndexError', 'i') THEN 6 ELSE 7 END AS rule
  FROM dead
),
diag AS (
  SELECT *,
    CASE rule WHEN 1 THEN 'Deserialization Syntax Error' WHEN 2 THEN 'Schema Validation Failure'
      WHEN 3 THEN 'Protobuf Deserialization Failure' WHEN 4 THEN 'Downstream Service Outage'
      WHEN 5 THEN 'Idempotency or Conflict Rejection' WHEN 6 THEN 'Uncaught Null / Key Exception'
      ELSE 'Unclassified Error' END AS failure_category,
    CASE rule WHEN 1 THEN 'Corrupted or incomplete JSON syntax in message payload.'
      WHEN 2 THEN 'Payload fails structural or constraint validation in consumer.'
      WHEN 3 THEN 'Binary payload does not match expected Protobuf schema definition.'
      WHEN 4 THEN 'Processing failed due to temporary network or dependency unavailability.'
      WHEN 5 THEN 'Message with this identifier was already processed or caused state conflict.'
      WHEN 6 THEN 'Consumer crashed expecting a field that was not present in the payload.' ELSE exc_msg END AS root_cause,
    CASE rule WHEN 1 THEN 'Fix malformed JSON brackets, quotes, or characters in the payload.'
      WHEN 2 THEN 'Update rejected properties to satisfy contract constraints.'
      WHEN 3 THEN 'Verify schema contract version or synchronize message definition.'
      WHEN 4 THEN 'Safe to redrive directly without altering payload once service recovers.'
      WHEN 5 THEN 'Inspect entity state before redriving to avoid unintended duplicates.'
      WHEN 6 THEN 'Supply the missing property in the payload editor.'
      ELSE 'Review stack trace and inspect payload fields.' END AS suggested_action,
    nullif(regexp_replace(nullif(regexp_extract(txt, '([\\w.]+(?:Exception|Error))', 1), ''), '^.*\\.', ''), '') AS exception_type
  FROM ruled
)"""
)

ENDS = (
    REC
    + """,
ends AS (SELECT topic, "partition", max("offset") + 1 AS log_end_offset FROM rec GROUP BY ALL),
committed AS (
  SELECT 'billing' AS group_id, topic, "partition", log_end_offset - 60 * "partition" AS committed_offset
  FROM ends WHERE "partition" <> 3
  UNION ALL
  SELECT 'audit', topic, "partition", log_end_offset + 5 - 4 * "partition" FROM ends WHERE topic = 'user.events'
),
lags AS (
  SELECT g.group_id, e.topic, e."partition", e.log_end_offset, CAST(coalesce(c.committed_offset, 0) AS BIGINT) AS current_offset,
    CAST(greatest(0, e.log_end_offset - coalesce(c.committed_offset, 0)) AS BIGINT) AS lag
  FROM (SELECT DISTINCT group_id, topic FROM committed) g JOIN ends e USING (topic)
  LEFT JOIN committed c ON c.group_id = g.group_id AND c.topic = e.topic AND c."partition" = e."partition"
)"""
)

COORDS = 'topic, "partition", "offset"'


def _hops(source: str, id_expr: str, where: str, extra: str = "") -> str:
    """Step and latency by one window per trace."""
    return f"""
hop AS (
  SELECT {id_expr} AS correlation_id, *{extra} FROM {source} WHERE {where}
),
hops AS (
  SELECT *, row_number() OVER w AS step,
    CAST(CASE WHEN timestamp_ms - lag(timestamp_ms) OVER w IS NOT NULL
      THEN greatest(0, timestamp_ms - lag(timestamp_ms) OVER w) END AS DOUBLE) AS latency_ms,
    CASE WHEN is_dlq THEN 'DLQ_POISON' ELSE 'OK' END AS status
  FROM hop WINDOW w AS (PARTITION BY correlation_id ORDER BY timestamp_ms, "offset", topic, "partition")
)"""


def _totals(source: str) -> str:
    return f"""
seen AS (
  SELECT correlation_id, topic, min(timestamp_ms) AS first_at, arg_min("offset", (timestamp_ms, "offset")) AS off
  FROM {source} GROUP BY ALL
),
path AS (SELECT correlation_id, string_agg(topic, ' > ' ORDER BY first_at, off) AS topics FROM seen GROUP BY ALL),
total AS (
  SELECT correlation_id, count(*) AS hops,
    CASE WHEN count(*) >= 2 AND min(timestamp_ms) <> 0 AND max(timestamp_ms) <> 0
      THEN CAST(max(timestamp_ms) - min(timestamp_ms) AS DOUBLE) END AS total_latency_ms,
    bool_or(is_dlq) AS has_dlq
  FROM {source} GROUP BY ALL
)"""


SUMMARY = "SELECT correlation_id, hops, total_latency_ms, has_dlq, topics FROM total JOIN path USING (correlation_id)"


LIFECYCLE = """
life AS (
  SELECT 'order.events' AS topic, CAST(o_orderkey % 4 AS INTEGER) AS "partition", o_orderkey AS "offset",
    epoch_us(o_orderdate) // 1000 AS timestamp_ms, 'order_' || o_orderkey AS correlation_id, o_orderstatus = 'F' AS is_dlq,
    'OrderCreated' AS event_type
  FROM orders
  UNION ALL
  SELECT 'shipment.events', CAST(l_orderkey % 4 AS INTEGER), l_orderkey * 10 + l_linenumber, epoch_us(l_shipdate) // 1000,
    'order_' || l_orderkey, false, 'Shipped'
  FROM lineitem
)"""

PREVIEW = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1} - 3) || '...' ELSE {0} END"

BATCH = (
    DIAGNOSED
    + """,
flag AS (
  SELECT *, orig_topic IS NOT NULL AND contains(lower(failure_category), 'failure') AS matched,
    sum(CASE WHEN orig_topic IS NOT NULL AND contains(lower(failure_category), 'failure') THEN 1 ELSE 0 END)
      OVER (ORDER BY topic, "partition", "offset") AS nth
  FROM diag
)"""
)

SENT = """
SELECT {target} AS target, key, {value} AS value,
  {names} AS header_names,
  CAST("offset" AS VARCHAR) AS sent_from, topic AS source_topic, "partition" AS source_partition, "offset" AS source_offset,
  {success} AS success, {error} AS error
FROM {source}"""
PLAIN_NAMES = "'x-correlation-id,x-redrive-source-offset,x-redrive-source-topic,x-redriven-by'"

PAIRS = """
sides AS (
  SELECT event_id AS pair_id, event_type, CAST("value" AS DECIMAL(12,2)) AS amount, event_id % 90 AS new_k,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS old_k
  FROM events
),
items AS (
  SELECT pair_id, 'event_type' AS path, 'modified' AS diff_type, '"' || event_type || '"' AS old_value, '"view"' AS new_value
  FROM sides WHERE pair_id % 4 = 0 AND event_type <> 'view'
  UNION ALL
  SELECT pair_id, 'total', 'modified', rtrim(rtrim(CAST(amount AS VARCHAR), '0'), '.'),
    rtrim(rtrim(CAST(amount + 1 AS VARCHAR), '0'), '.')
  FROM sides WHERE pair_id % 6 = 0
  UNION ALL
  SELECT pair_id, 'props.k', 'modified', CAST(old_k AS VARCHAR), CAST(new_k AS VARCHAR) FROM sides WHERE old_k <> new_k
  UNION ALL
  SELECT pair_id, 'props.note', 'added', NULL, '{"by":"ops"}' FROM sides WHERE pair_id % 5 = 0
  UNION ALL
  SELECT pair_id, 'obsolete', 'removed', 'true', NULL FROM sides WHERE pair_id % 3 = 0
  UNION ALL
  SELECT pair_id, 'tags', 'modified', '[1,2]', '[1,3]' FROM sides WHERE pair_id % 8 = 0
)"""

MESSAGES = """
msg AS (SELECT *, event_id % 9 = 0 AS cut, 128 + event_id % 1000 AS seq FROM rec WHERE event_type = 'purchase')"""
PROTO_ROWS = f"{REC.strip()},{MESSAGES}"

WANTED = """
wanted AS (SELECT DISTINCT 'ORD_' || (event_id // 5) AS wanted_id FROM events WHERE "value" > 40)"""

SEARCHED = "concat_ws(chr(1), key, corr, order_id, CASE WHEN ok THEN 'evt_' || event_id END, CASE WHEN ok THEN 'cust_' || user_id END)"

BATCH_TOTALS = """
SELECT 'user.events.dlq' AS source_topic,
  coalesce((SELECT orig_topic FROM {source} ORDER BY topic, "partition", "offset" LIMIT 1), 'unknown') AS target_topic,
  count(*) AS total_scanned, {matched} AS matched_count, {matched} AS redriven_count, {skipped} AS skipped_count,
  CAST(0 AS BIGINT) AS failed_count, {dry} AS dry_run
FROM {source}"""


def _sql(body: str, *parts: str) -> str:
    return f"WITH {','.join(p.strip() for p in parts)}\n{body.strip()}" if parts else body.strip()


ORACLE: dict[str, str] = {
    "tail_n_per_partition": _sql(
        f"SELECT {COORDS}, key, format AS payload_format FROM log "
        'QUALIFY row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset" DESC) <= 5',
        DOC,
    ),
    "tail_long_per_partition": _sql(
        'SELECT topic, "partition", count(*) AS records, min("offset") AS first_offset FROM (SELECT * FROM rec '
        'QUALIFY row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset" DESC) <= 1100) GROUP BY ALL',
        REC,
    ),
    "stop_before_filter": _sql(
        f'SELECT {COORDS} FROM (SELECT * FROM rec ORDER BY topic, "partition", "offset" LIMIT 700) WHERE is_dlq', REC
    ),
    "stop_after_filter": _sql(
        f"SELECT {COORDS}, timestamp_ms FROM rec WHERE NOT is_dlq AND timestamp_ms % 3 = 0 "
        'ORDER BY topic, "partition", "offset" LIMIT 70',
        REC,
    ),
    "read_offset_range": _sql(
        f"SELECT {COORDS}, timestamp_ms FROM rec WHERE topic = 'payment.events' AND \"offset\" BETWEEN 100 AND 900", REC
    ),
    "read_one_partition": _sql(
        f"SELECT {COORDS}, timestamp_ms FROM rec WHERE topic = 'user.events' AND \"partition\" = 2", REC
    ),
    "read_topics": _sql(
        "SELECT topic, count(*) AS records FROM rec WHERE topic IN ('payment.events', 'user.events.dlq') GROUP BY topic", REC
    ),
    "topic_partitions": _sql('SELECT DISTINCT topic, "partition" FROM rec', REC),
    "partition_watermarks": _sql(
        'SELECT topic, "partition", min("offset") AS beginning_offset, max("offset") + 1 AS log_end_offset FROM rec GROUP BY ALL',
        REC,
    ),
    "record_lookup": _sql(
        f"SELECT {COORDS}, key FROM rec r WHERE EXISTS (SELECT 1 FROM rec d WHERE d.orig_topic = r.topic "
        'AND d.orig_partition = r."partition" AND d.orig_offset = r."offset")',
        REC,
    ),
    "normalize_records": _sql(
        f"SELECT {COORDS}, timestamp_ms, key, text_value AS value, corr AS correlation, "
        "CAST(1 + (exc_msg IS NOT NULL)::INT + (stack IS NOT NULL)::INT + 3 * (orig_topic IS NOT NULL)::INT AS BIGINT) AS header_count, "
        "is_dlq, exc_msg AS error_message FROM mixed",
        MIXED,
    ),
    "decode_formats": _sql(
        "SELECT format AS payload_format, count(*) AS records, count(*) FILTER (format IN ('json', 'avro')) AS structured, "
        "count(schema_id) AS framed FROM mixed GROUP BY format",
        MIXED,
    ),
    "decode_frames": _sql(
        """SELECT "offset", schema_id, CAST(schema_id AS VARCHAR) AS id_in_payload,
          CASE WHEN frame_kind = 'json' THEN json_extract_string(body, '$.order_id') END AS order_id,
          CASE WHEN frame_kind = 'hex' THEN 'confluent-avro' END AS wire_format,
          CASE WHEN frame_kind = 'hex' THEN lower(substr(hex(b), 11)) END AS payload_hex,
          CASE WHEN frame_kind = 'hex' THEN octet_length(b) - 5 END AS payload_length FROM mixed WHERE framed""",
        MIXED,
    ),
    "schema_lookup": _sql(
        """SELECT "offset", schema_id, d AS schema_definition, t AS schema_type FROM mixed LEFT JOIN (VALUES
          (101, '{"type":"record","name":"Order"}', 'AVRO'), (102, '{"type":"object"}', 'JSON')) s(id, d, t) ON schema_id = id""",
        MIXED,
    ),
    "decode_protobuf": _sql(
        """SELECT "offset", 'protobuf' AS payload_format, CASE WHEN NOT cut THEN 'evt_' || event_id END AS event_id,
          CASE WHEN NOT cut THEN 'ord_' || (event_id // 5) END AS order_id, CASE WHEN NOT cut THEN '' END AS currency,
          CASE WHEN NOT cut THEN CAST(seq AS VARCHAR) END AS sequence_number, cut AS failed FROM msg""",
        PROTO_ROWS,
    ),
    "decode_wire": _sql(
        """SELECT "offset", 'protobuf' AS payload_format, CASE WHEN cut THEN substr('evt_' || event_id, 1, 2)
          ELSE 'evt_' || event_id END AS tag_1, CASE WHEN NOT cut THEN 'cust_' || user_id END AS tag_3,
          CASE WHEN NOT cut THEN seq END AS tag_7 FROM msg""",
        PROTO_ROWS,
    ),
    "decode_all_kinds": _sql(
        """SELECT topic, "offset", format AS payload_format, format IN ('json', 'avro') AS is_structured, schema_id,
          CAST(NULL AS VARCHAR) AS tag_1 FROM mixed
        UNION ALL SELECT 'payment.proto', "offset", 'protobuf', true, NULL,
          CASE WHEN cut THEN substr('evt_' || event_id, 1, 2) ELSE 'evt_' || event_id END FROM msg""",
        MIXED,
        MESSAGES,
    ),
    "decode_plug_in": _sql(
        "SELECT CASE WHEN ok THEN 'json' ELSE 'repaired' END AS payload_format, count(*) AS records, count(*) AS with_order "
        "FROM log GROUP BY ok",
        DOC,
    ),
    "summary_view": _sql(
        f"SELECT {COORDS}, timestamp_ms AS timestamp, key, format, is_dlq, corr AS correlation, text AS payload FROM log", DOC
    ),
    "table_view": _sql(
        f"""SELECT CASE WHEN is_dlq THEN 'DLQ' ELSE 'OK' END AS status, "partition", "offset", key, format,
          {PREVIEW.format('shown', 60)} AS preview, CAST(timestamp_ms AS VARCHAR) AS timestamp
        FROM (SELECT *, coalesce(CASE WHEN format = 'json' OR frame_kind = 'json' THEN '{{' || CASE WHEN framed
            THEN '"_schema_id":' || schema_id || ',' ELSE '' END || '"customer_id":"cust_' || user_id || '","event_id":"evt_' || event_id
            || '","event_type":"' || event_type || '","order_id":"ord_' || (event_id // 5) || '","props":{{"k":'
            || json_extract_string(props, '$.k') || '}},"total_amount":'
            || rtrim(rtrim(CAST(CAST(amount AS DECIMAL(12,2)) AS VARCHAR), '0'), '.') || '}}'
          WHEN frame_kind = 'hex' THEN '{{"_schema_id":' || schema_id || ',"_wire_format":"confluent-avro","payload_hex":"'
            || lower(substr(hex(b), 11)) || '","payload_length_bytes":' || (octet_length(b) - 5) || '}}'
          ELSE text_value END, '') AS shown FROM mixed)""",
        MIXED,
    ),
    "raw_view": _sql(
        "SELECT '[' || \"partition\" || ':' || \"offset\" || '] ' || coalesce(text_value, 'None') AS line FROM mixed", MIXED
    ),
    "dlq_list_view": _sql(f"SELECT \"offset\", key, {PREVIEW.format('exc_msg', 30)} AS error FROM rec WHERE is_dlq", REC),
    "dlq_inspect_view": _sql(
        f"""SELECT {COORDS}, key, failure_category, root_cause, suggested_action,
          '  x-correlation-id: ' || corr || chr(10) || '  x-exception-message: ' || exc_msg
          || coalesce(chr(10) || '  x-exception-stacktrace: ' || stack, '')
          || coalesce(chr(10) || '  x-original-offset: ' || orig_offset, '')
          || coalesce(chr(10) || '  x-original-partition: ' || orig_partition, '')
          || coalesce(chr(10) || '  x-original-topic: ' || orig_topic, '') AS headers_text,
          CASE WHEN json_valid(value) THEN '{{"customer_id":"cust_' || user_id || '","event_id":"evt_' || event_id || '","event_type":"'
            || event_type || '","order_id":"ord_' || (event_id // 5) || '","props":{{"k":' || json_extract_string(props, '$.k')
            || '}},"total_amount":' || rtrim(rtrim(CAST(CAST(amount AS DECIMAL(12,2)) AS VARCHAR), '0'), '.') || '}}'
          ELSE value END AS payload_text
        FROM diag ORDER BY topic, "partition", "offset" LIMIT 50""",
        DIAGNOSED,
    ),
    "flatten_payload": _sql(
        """SELECT "offset", replace(t.fullkey, '$.', '') AS path,
          CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'leaf' END AS node_type,
          CASE WHEN t.type = 'OBJECT' THEN NULL WHEN t.fullkey = '$.total_amount' THEN amount_text
            ELSE json_extract_string(log.value, t.fullkey) END AS leaf_text
        FROM log, json_tree(log.value) t WHERE ok AND t.fullkey <> '$'""",
        DOC,
    ),
    "filter_predicate": _sql(f"SELECT {COORDS}, value FROM log WHERE doc_type = 'purchase' AND total > 30", DOC),
    "filter_sql_predicate": _sql(
        f"SELECT {COORDS}, key FROM log WHERE k >= 50 AND key LIKE 'user_1%' AND topic = 'user.events'", DOC
    ),
    "filter_truthy": _sql("SELECT topic, count(*) AS records FROM log WHERE coalesce(k, 0) <> 0 GROUP BY topic", DOC),
    "filter_value_fallback": _sql(f"SELECT {COORDS}, key, true AS undecoded FROM log WHERE total > 30", DOC),
    "filter_regex": _sql(
        f"""SELECT {COORDS}, key FROM log WHERE regexp_matches(text, 'timeout|user_7$|cust_12"', 'i')
          OR regexp_matches(key, 'timeout|user_7$|cust_12"', 'i')
          OR regexp_matches('x-correlation-id:' || corr, 'timeout|user_7$|cust_12"', 'i')
          OR coalesce(regexp_matches('x-exception-message:' || exc_msg, 'timeout|user_7$|cust_12"', 'i'), false)""",
        DOC,
    ),
    "filter_combined": _sql(
        f"SELECT {COORDS}, key FROM log WHERE total < 20 AND regexp_matches('x-correlation-id:' || corr, 'corr-[0-9]*7$', 'i')", DOC
    ),
    "keyword_search": _sql(
        f"SELECT {COORDS}, key FROM log WHERE contains(lower(concat_ws(' ', topic, key, corr, exc_msg, stack, text)), 'nullpointer')",
        DOC,
    ),
    "dlq_only": _sql(f"SELECT {COORDS}, exc_msg AS error_message FROM rec WHERE is_dlq", REC),
    "lag_by_partition": _sql('SELECT group_id, topic, "partition", log_end_offset, current_offset, lag FROM lags', ENDS),
    "lag_of_group": _sql(
        """SELECT 'billing' AS group_id, topic, "partition", log_end_offset, CAST(coalesce(committed_offset, 0) AS BIGINT) AS current_offset,
          CAST(greatest(0, log_end_offset - coalesce(committed_offset, 0)) AS BIGINT) AS lag
        FROM ends LEFT JOIN (SELECT * FROM committed WHERE group_id = 'billing') USING (topic, "partition")""",
        ENDS,
    ),
    "lag_without_group": _sql(
        'SELECT \'none\' AS group_id, topic, "partition", log_end_offset, log_end_offset AS current_offset, CAST(0 AS BIGINT) AS lag FROM ends',
        ENDS,
    ),
    "lag_total": _sql(
        """SELECT group_id, topic, CAST(sum(lag) AS BIGINT) AS total_lag, count(*) AS partitions FROM lags GROUP BY ALL
        UNION ALL SELECT 'unassigned', 'no.such.topic', CAST(0 AS BIGINT), CAST(0 AS BIGINT)""",
        ENDS,
    ),
    "lag_meter": _sql(
        """SELECT group_id, topic, "partition", lag,
          CASE WHEN lag > 50 THEN 'red' WHEN lag > 10 THEN 'yellow' ELSE 'green' END AS severity,
          repeat('#', CAST(least(25, lag // 10) AS BIGINT)) AS meter,
          CASE WHEN lag > 100 THEN 'danger' WHEN lag > 30 THEN 'warn' ELSE '' END AS page_severity,
          CAST(least(100, floor(lag * 100 / 300.0 + 0.5)) AS BIGINT) AS percent,
          CAST(greatest(5, least(100, floor(lag * 100 / 300.0 + 0.5))) AS BIGINT) AS bar_percent FROM lags""",
        ENDS,
    ),
    "lag_share": _sql(
        """SELECT group_id, topic, "partition", round(CASE WHEN sum(lag) OVER w > 0 THEN lag / CAST(sum(lag) OVER w AS DOUBLE)
          ELSE 0.0 END, 6) AS lag_share FROM lags WINDOW w AS (PARTITION BY group_id, topic)""",
        ENDS,
    ),
    "status_counts": _sql(
        "SELECT topic, count(*) AS events, count(*) FILTER (is_dlq) AS dlq_events FROM rec GROUP BY topic", REC
    ),
    "throughput_1s": _sql(
        "SELECT timestamp_ms // 1000 * 1000 AS window_start_ms, count(*) AS events, count(*) FILTER (is_dlq) AS dlq_events "
        "FROM rec GROUP BY ALL",
        REC,
    ),
    "recent_events": _sql(
        f'SELECT {COORDS}, timestamp_ms, key FROM rec ORDER BY timestamp_ms DESC, "offset" DESC LIMIT 300', REC
    ),
    "recent_dlq_diagnosed": _sql(
        f'SELECT {COORDS}, failure_category, exception_type FROM diag ORDER BY timestamp_ms DESC, "offset" DESC LIMIT 100', DIAGNOSED
    ),
    "dlq_diagnose": _sql(
        f"""SELECT {COORDS}, failure_category, root_cause, suggested_action, orig_topic AS original_topic,
          orig_partition AS original_partition, orig_offset AS original_offset, exception_type, exc_msg AS exception_message,
          stack AS stack_trace FROM diag""",
        DIAGNOSED,
    ),
    "dlq_by_category": _sql(
        "SELECT failure_category, count(*) AS records, count(orig_topic) AS with_target FROM diag GROUP BY ALL", DIAGNOSED
    ),
    "dlq_own_rules": _sql(
        """SELECT CASE WHEN regexp_matches(txt, 'gateway', 'i') THEN 'Gateway' WHEN regexp_matches(txt, 'null|id', 'i') THEN 'Data'
          ELSE 'Unclassified Error' END AS failure_category, count(*) AS records, count(orig_topic) AS with_target
        FROM diag GROUP BY ALL""",
        DIAGNOSED,
    ),
    "dlq_source_link": _sql(
        """SELECT d.topic, d."partition", d."offset", d.orig_offset AS original_offset, r.value AS source_value,
          r.timestamp_ms AS source_timestamp_ms FROM rec d LEFT JOIN rec r
          ON d.orig_topic = r.topic AND d.orig_partition = r."partition" AND d.orig_offset = r."offset" WHERE d.is_dlq""",
        REC,
    ),
    "redrive_plan": _sql(
        SENT.format(
            target="coalesce(orig_topic, '')",
            value="value",
            names=PLAIN_NAMES,
            success="orig_topic IS NOT NULL",
            error="CASE WHEN orig_topic IS NULL THEN 'Target topic unspecified and ''x-original-topic'' header missing.' END",
            source="diag",
        ),
        DIAGNOSED,
    ),
    "redrive_keep_headers": _sql(
        SENT.format(
            target="'user.retry'",
            value="value",
            names="""concat_ws(',', 'x-correlation-id', 'x-exception-message',
              CASE WHEN stack IS NOT NULL THEN 'x-exception-stacktrace' END,
              CASE WHEN orig_topic IS NOT NULL THEN 'x-original-offset,x-original-partition,x-original-topic' END,
              'x-redrive-source-offset,x-redrive-source-topic,x-redriven-by')""",
            success="true",
            error="CAST(NULL AS VARCHAR)",
            source="diag",
        ),
        DIAGNOSED,
    ),
    "redrive_patched": _sql(
        SENT.format(
            target="'user.events'",
            value="CASE WHEN rule = 1 THEN '{\"fixed\":' || \"offset\" || '}' ELSE value END",
            names=PLAIN_NAMES,
            success="true",
            error="CAST(NULL AS VARCHAR)",
            source="diag",
        ),
        DIAGNOSED,
    ),
    "redrive_publish": _sql(
        f"SELECT orig_topic AS topic, key, value, CAST(1 + length({PLAIN_NAMES}) - length(replace({PLAIN_NAMES}, ',', '')) AS BIGINT) "
        "AS header_count FROM rec WHERE is_dlq AND orig_topic IS NOT NULL",
        REC,
    ),
    "redrive_without_sent": _sql(f'SELECT {COORDS} FROM rec WHERE is_dlq AND "offset" % 2 <> 0', REC),
    "redrive_batch_summary": _sql(
        BATCH_TOTALS.format(
            source="diag", matched="count(orig_topic)", skipped="count(*) - count(orig_topic)", dry="true"
        ),
        DIAGNOSED,
    ),
    "redrive_batch_category": _sql(
        BATCH_TOTALS.format(
            source="diag",
            matched="count(*) FILTER (orig_topic IS NOT NULL AND rule = 4 AND amount > 10)",
            skipped="count(*) - count(*) FILTER (orig_topic IS NOT NULL AND rule = 4 AND amount > 10)",
            dry="false",
        ),
        DIAGNOSED,
    ),
    "redrive_batch_limit": _sql(
        BATCH_TOTALS.format(
            source="flag",
            matched="least(50, count(*) FILTER (matched))",
            skipped="count(*) FILTER (NOT matched AND nth < 50)",
            dry="true",
        ),
        BATCH,
    ),
    "redrive_batch_plan": _sql(
        """SELECT orig_topic AS target, topic AS source_topic, "partition" AS source_partition, "offset" AS source_offset,
          "partition" AS produced_partition, "offset" AS produced_offset FROM flag WHERE matched AND nth <= 50""",
        BATCH,
    ),
    "trace_one": _sql(
        f"SELECT correlation_id, step, {COORDS}, timestamp_ms, doc_type AS event_type, status, latency_ms FROM hops",
        DOC,
        _hops("log", "'ORD_12'", f"contains({SEARCHED}, 'ord_12')"),
    ),
    "trace_hop_view": _sql(
        """SELECT correlation_id, step, topic, "partition" || ':' || "offset" AS position,
          coalesce(doc_type, substr(exc_msg, 1, 20), 'Message') AS event,
          coalesce('+' || CAST(CAST(latency_ms AS BIGINT) AS VARCHAR) || ' ms', 'START') AS delta,
          CASE WHEN is_dlq THEN 'POISON (DLQ)' ELSE 'SUCCESS' END AS status FROM hops""",
        DOC,
        _hops("log", "'corr-77'", f"contains({SEARCHED}, 'corr-77')"),
    ),
    "trace_all_hops": _sql(
        f"SELECT correlation_id, step, {COORDS}, status, latency_ms FROM hops", REC, _hops("rec", "corr", "true")
    ),
    "trace_one_hot_key": _sql(
        f"SELECT correlation_id, step, {COORDS}, latency_ms FROM hops",
        REC,
        _hops("rec", "CASE WHEN \"offset\" % 3 = 0 THEN 'hot' ELSE 't' || (\"offset\" % 2) END", "true"),
    ),
    "trace_summary": _sql(SUMMARY, REC, "traced AS (SELECT *, corr AS correlation_id FROM rec)", _totals("traced")),
    "trace_order_lifecycle": _sql(SUMMARY, LIFECYCLE, _totals("life")),
    "trace_order_hops": _sql(
        'SELECT correlation_id, step, topic, "offset", event_type, latency_ms FROM hops',
        LIFECYCLE,
        _hops("life", "correlation_id", "true").replace("correlation_id AS correlation_id, *", "*"),
    ),
    "trace_many": _sql(
        f"SELECT correlation_id, step, {COORDS}, latency_ms FROM hops",
        DOC,
        WANTED,
        _hops("log JOIN wanted ON contains(" + SEARCHED + ", lower(wanted_id))", "wanted_id", "true"),
    ),
    "trace_many_exact": _sql(
        f"SELECT correlation_id, step, {COORDS}, latency_ms FROM hops",
        DOC,
        WANTED,
        _hops("log JOIN wanted ON order_id = lower(wanted_id)", "wanted_id", "true"),
    ),
    "diff_items": _sql("SELECT pair_id, path, diff_type, old_value, new_value FROM items", PAIRS),
    "diff_summary": _sql(
        """SELECT pair_id, count(*) FILTER (diff_type = 'added') AS added_count, count(*) FILTER (diff_type = 'removed') AS removed_count,
          count(*) FILTER (diff_type = 'modified') AS modified_count, count(diff_type) = 0 AS identical
        FROM sides LEFT JOIN items USING (pair_id) GROUP BY pair_id""",
        PAIRS,
    ),
    "diff_dlq_source": _sql(
        """SELECT pair_id, path, diff_type FROM (
          SELECT pair_id, 'value' AS path, 'modified' AS diff_type, NOT dok AS hit FROM linked
          UNION ALL SELECT pair_id, 'event_id', 'modified', dok FROM linked
          UNION ALL SELECT pair_id, 'event_type', 'modified', dok AND dtype <> rtype FROM linked
          UNION ALL SELECT pair_id, 'order_id', 'modified', dok AND dorder <> rorder FROM linked
          UNION ALL SELECT pair_id, 'customer_id', 'modified', dok AND duser <> ruser FROM linked
          UNION ALL SELECT pair_id, 'total_amount', 'modified', dok AND dtotal <> rtotal FROM linked
          UNION ALL SELECT pair_id, 'props.k', 'modified', dok AND dk <> rk FROM linked) WHERE hit""",
        DOC,
        """linked AS (
  SELECT d."offset" AS pair_id, d.ok AS dok, d.doc_type AS dtype, r.doc_type AS rtype, d.order_id AS dorder, r.order_id AS rorder,
    d.user_id AS duser, r.user_id AS ruser, d.total AS dtotal, r.total AS rtotal, d.k AS dk, r.k AS rk
  FROM log d JOIN log r ON d.orig_topic = r.topic AND d.orig_partition = r."partition" AND d.orig_offset = r."offset" WHERE d.is_dlq)""",
    ),
    "replay_plan": _sql(
        """SELECT 'user.replay' AS topic, "partition", "offset", key, 'day.lens' AS source_file,
          CAST(3 + (exc_msg IS NOT NULL)::INT + (stack IS NOT NULL)::INT + 3 * (orig_topic IS NOT NULL)::INT AS BIGINT) AS header_count,
          round(pause, 5) AS delay_s, round(sum(pause) OVER w, 5) AS replay_at_s,
          row_number() OVER w AS sequence, true AS published
        FROM paused WINDOW w AS (ORDER BY timestamp_ms, "offset", topic, "partition")""",
        REC,
        """paused AS (
  SELECT *, coalesce(least(5.0::DOUBLE, greatest(0, timestamp_ms - lag(timestamp_ms)
    OVER (ORDER BY timestamp_ms, "offset", topic, "partition"))::DOUBLE / 1000.0 / 100.0), 0.0) AS pause FROM rec)""",
    ),
    "publish_records": _sql(
        """SELECT 'user.copy' AS topic, key, value,
          CAST(1 + (exc_msg IS NOT NULL)::INT + (stack IS NOT NULL)::INT + 3 * (orig_topic IS NOT NULL)::INT AS BIGINT) AS header_count
        FROM rec""",
        REC,
    ),
    "session_stamped": _sql(f"SELECT {COORDS}, true AS stamped FROM rec", REC),
    "session_roundtrip": _sql(
        f"SELECT timestamp_ms AS time_recorded_ms, {COORDS}, timestamp_ms AS timestamp, key, value, corr AS correlation, "
        "format AS payload_format, is_dlq FROM log",
        DOC,
    ),
    "export_csv_rows": _sql(
        'SELECT topic AS "Topic", "partition" AS "Partition", "offset" AS "Offset", key AS "Key", format AS "Format", '
        'timestamp_ms AS "Timestamp", is_dlq AS "Is_DLQ", text AS "Payload" FROM log WHERE is_dlq',
        DOC,
    ),
    "export_json_lines": _sql(
        f"SELECT {COORDS}, timestamp_ms AS timestamp, key, format, is_dlq FROM log", DOC
    ),
    "export_json_array": _sql(
        "SELECT '[' AS mark, CAST(1 AS BIGINT) AS lines UNION ALL SELECT ']', CAST(1 AS BIGINT) UNION ALL SELECT ' ', CAST(1 AS BIGINT) "
        "UNION ALL SELECT ',', count(*) - 1 FROM rec",
        REC,
    ),
    "produce_template": _sql(
        """SELECT 'user.test' AS topic, 'user_' || user_id || '_' || i AS key, '{"id":' || event_id || '}' AS value,
          'x-a=' || user_id || ';x-url=http://h:80' AS headers
        FROM events, (VALUES (1), (2), (3)) t(i) WHERE event_type = 'signup'"""
    ),
}
ORACLE |= {
    "stream_tail": _sql(
        f"""SELECT CASE WHEN is_dlq THEN 'DLQ' ELSE 'OK' END AS status, "partition", "offset", key, format,
          {PREVIEW.format('text', 60)} AS preview, CAST(timestamp_ms AS VARCHAR) AS timestamp FROM log WHERE total > 60""",
        DOC,
    ),
    "stream_alerts": _sql(
        "SELECT \"offset\", 'Poison Pill detected on ' || topic || ' [P:' || \"partition\" || ' Offset:' || \"offset\" || ']!' AS alert "
        "FROM rec WHERE is_dlq",
        REC,
    ),
    "redrive_patch_file": ORACLE["redrive_patched"],
    "stream_throughput": ORACLE["throughput_1s"],
    "stream_trace": ORACLE["trace_all_hops"],
    "stream_trace_summary": ORACLE["trace_summary"],
    "stream_recent": ORACLE["recent_events"],
    "stream_session": _sql(f"SELECT {COORDS}, timestamp_ms AS timestamp, key, value, is_dlq FROM rec", REC),
    "stream_lag": ORACLE["lag_by_partition"],
}
