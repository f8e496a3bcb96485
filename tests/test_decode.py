import json
import random

import pytest
from pyspark.sql import functions as F

from topicwise.operators import protobuf
from topicwise.operators.decode import attach_schema, decode, to_records
from topicwise.operators.protobuf import ProtoSpec
from topicwise.operators.views import flatten_payload
from topicwise.operators.wire import read_wire, wire_json
from topicwise.plans.inputs import order_message
from topicwise.schemas import RECORD, SCHEMA_ENTRY

PROTO = [("content-type", b"application/x-protobuf")]
CASES = [
    (b'{"tank": "T-7", "litres": 12.75}', [], "json", '{"litres":12.75,"tank":"T-7"}'),
    (b" [1, 2] ", [], "json", "[1,2]"),
    (b'{"a":1,"a":2}', [], "json", '{"a":2}'),
    (b"plain words only", [], "text", None),
    (b"{\"tank\": T-7,", [], "text", None),
    (b'{"a":1}}', [], "text", None),
    (b'{"a":1} x', [], "text", None),
    (b"{},0],{}", [], "text", None),
    (b"123", [], "text", None),
    (b"\x00\x00\x00\x00\x2a" + b'{"valve": "V3"}', [], "avro", '{"_schema_id":42,"valve":"V3"}'),
    (b"\x00\x00\x00\x00\x2a{ }", [], "avro", '{"_schema_id":42}'),
    (b"\x00\x00\x00\x00\x2a" + b'{"_schema_id":7}', [], "avro", '{"_schema_id":7}'),
    (b"\x00\x00\x00\x00\x2a[1]", [], "avro", '{"_schema_id":42,"content":[1]}'),
    (
        b"\x00\x00\x00\x00\x2a\xff\x01",
        [],
        "avro",
        '{"_schema_id":42,"_wire_format":"confluent-avro","payload_hex":"ff01","payload_length_bytes":2}',
    ),
    (
        b"\x00\x00\x00\x00\x2a1,2",
        [],
        "avro",
        '{"_schema_id":42,"_wire_format":"confluent-avro","payload_hex":"312c32","payload_length_bytes":3}',
    ),
    (b"\x01\x00\x00\x00\x2awords", [], "text", None),
    (b"tiny", [], "text", None),
    (b"\x08\x7b", PROTO, "protobuf", '{"tag_1":123}'),
    (b"\x08\x7b", [], "text", None),
    (None, [], "null", None),
    (b"", PROTO, "raw", None),
    (b"\xff\x00\x41", [], "binary", None),
]


def test_formats(raw):
    rows = [("t", 0, i, 1, b"k", value, headers) for i, (value, headers, _, _) in enumerate(CASES)]
    found = (
        to_records(raw(*rows)).orderBy("offset").select("payload_format", F.to_json("payload").alias("p"), "is_structured").collect()
    )
    assert [(r.payload_format, r.p) for r in found] == [(fmt, p) for _, _, fmt, p in CASES]
    assert [r.is_structured for r in found] == [p is not None for _, _, _, p in CASES]


def test_schema_of_record(raw):
    df = to_records(raw(("t", 0, 0, 1, b"k", b"v", [])))
    assert df.columns == RECORD.names
    assert [f.dataType for f in df.schema] == [f.dataType for f in RECORD]


def test_text_headers_and_flags(raw):
    rows = to_records(
        raw(
            ("orders", 0, 0, 5, b"\xff\x01", b"\xfe", [("a", b"1"), ("a", b"2"), ("b", None), ("c", b"\xff")]),
            ("orders", 0, 1, 5, b"", b"x", [("x-exception-message", b""), ("deadletter.reason", b"gone")]),
            ("Orders.DLQ", 0, 2, 5, None, None, []),
            ("orders", 0, 3, 5, b"k", b"x", [("x", "é".encode())]),
        ),
        wire=False,
    ).orderBy("offset").collect()
    assert (rows[0].key, rows[0].value) == ("0xff01", "0xfe")
    assert rows[0].headers == {"a": "2", "b": "", "c": "0xff"}
    assert (rows[1].key, rows[1].is_dlq, rows[1].error_message) == (None, True, "gone")
    assert (rows[2].key, rows[2].is_dlq, rows[2].error_message, rows[2].headers) == (None, True, None, {})
    assert (rows[3].is_dlq, rows[3].headers) == (False, {"x": "é"})


def test_protobuf_with_schema(raw):
    good = b"\x0a\x03evt\x12\x03ord\x38\x82\x01"
    rows = to_records(
        raw(
            ("t", 0, 0, 1, None, good, PROTO),
            ("t", 0, 1, 1, None, good, []),
            ("t", 0, 2, 1, None, b"\x0a\x20cut", PROTO),
            ("t", 0, 3, 1, None, b"\x0a\x20cut", []),
            ("t", 0, 4, 1, None, b'{"a":1}', []),
        ),
        order_message(),
    ).orderBy("offset").select("payload_format", F.to_json("payload").alias("p"), "decode_error", "error_message").collect()
    assert [r.payload_format for r in rows] == ["protobuf", "protobuf", "protobuf", "text", "json"]
    assert json.loads(rows[0].p) == {
        "event_id": "evt", "order_id": "ord", "customer_id": "", "currency": "", "sequence_number": "130",
    }
    assert rows[2].p is None and rows[2].decode_error.startswith("Protobuf schema decode error")
    assert rows[2].error_message == rows[2].decode_error and rows[3].decode_error is None


def test_default_message_is_the_first(raw):
    spec = ProtoSpec(order_message().descriptor_set)
    row = to_records(raw(("t", 0, 0, 1, None, b"\x0a\x01e", PROTO)), spec).select(F.to_json("payload").alias("p")).first()
    assert json.loads(row.p)["event_id"] == "e"


def test_wire_walk():
    assert read_wire(b"\x08\x7b") == {"tag_1": 123}
    assert read_wire(b"\x08\x01\x08\x02\x12\x02hi") == {"tag_1": [1, 2], "tag_2": "hi"}
    assert read_wire(b"\x12\x01\xff") == {"tag_2": "0xff"}
    assert read_wire(b"\x09" + b"\0" * 8 + b"\x15" + b"\0" * 4) == {"tag_1": "fixed64", "tag_2": "fixed32"}
    assert read_wire(b"\x08\x01\x0b\x08\x02") == {"tag_1": 1}


def test_plug_in_decoder(raw):
    rows = raw(("t", 0, 0, 1, None, b"k=v", []), ("t", 0, 1, 1, None, b"{}", []), ("t", 0, 2, 1, None, None, []))
    by_equals = ("pairs", F.contains(F.col("value").cast("string"), F.lit("=")), F.try_parse_json(F.lit('{"k":"v"}')))
    found = decode(rows, extra=[by_equals]).orderBy("offset").select("payload_format", F.to_json("payload").alias("p")).collect()
    assert [tuple(r) for r in found] == [("pairs", '{"k":"v"}'), ("json", "{}"), ("null", None)]


def test_attach_schema(spark, records):
    rows = records(
        ("t", 0, 0, 1, None, b"\x00\x00\x00\x00\x2a{}", []),
        ("t", 0, 1, 1, None, b"\x00\x00\x00\x00\x2b{}", []),
        ("t", 0, 2, 1, None, b"{}", []),
    )
    entries = spark.createDataFrame([(42, "S", None), (101, "T", "JSON")], SCHEMA_ENTRY)
    found = attach_schema(rows, entries).orderBy("offset").select("schema_definition", "schema_type").collect()
    assert [tuple(r) for r in found] == [("S", "AVRO"), (None, None), (None, None)]


def test_flatten(records):
    rows = records(("t", 0, 0, 1, None, b'{"a":{"b":[1,{"c":null}]},"d":"x","e":{}}', []), ("t", 0, 1, 1, None, b"text", []))
    found = {(r.path, r.node_type, r.leaf_text) for r in flatten_payload(rows).collect()}
    assert found == {
        ("a", "object", None), ("a.b", "array", None), ("a.b[0]", "leaf", "1"), ("a.b[1]", "object", None),
        ("a.b[1].c", "leaf", None), ("d", "leaf", "x"), ("e", "object", None),
    }
    assert {(r.path, r.node_type, r.leaf_text) for r in flatten_payload(rows, levels=1).collect()} == found


def test_flatten_any_depth(records):
    deep = b'{"a":' * 40 + b"[1,[]]" + b"}" * 40
    rows = flatten_payload(records(("t", 0, 0, 1, None, deep, []), ("t", 0, 1, 1, None, b'{"x":1}', [])))
    assert rows.count() == len(rows.collect()) == 40 + 2 + 1
    assert rows.filter("node_type = 'leaf'").select("leaf_text").distinct().count() == 1


def test_filters_reach_the_scan(spark, tmp_path, raw):
    raw(("t", 0, 0, 1, None, b"{}", [])).write.parquet(str(tmp_path / "log"))
    log = to_records(spark.read.parquet(str(tmp_path / "log")), wire=False)
    plan = log.filter("topic = 't' AND offset > 5 AND payload_format = 'json'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(topic,t)" in plan and "GreaterThan(offset,5)" in plan


def varint(n):
    return bytes([*(n >> 7 * i & 0x7F | 0x80 for i in range(max(0, n.bit_length() - 1) // 7)), n >> 7 * (max(0, n.bit_length() - 1) // 7)])


def test_wire_batch_equals_message_by_message():
    rng = random.Random(5)
    texts = [b"", b"plain", b'q"\\', "\u00e9\u65e5\n".encode(), b"\xff\x00", b"\x08\x01\x12\x02hi", b"x" * 300]

    def field():
        tag, kind = rng.choice([0, 1, 2, 3, 15, 16, 2**28, 2**61]), rng.choice([0, 0, 1, 2, 2, 2, 5, 3, 7] if rng.random() < 0.2 else [0, 1, 2, 2, 5])
        start = varint(tag << 3 | kind)
        if kind == 0:
            return start + varint(rng.choice([0, 1, 127, 128, 2**32, 2**63, 2**64 - 1, 2**64, 2**75]))
        text = rng.choice(texts)
        return start + {1: bytes(8), 5: bytes(4), 2: varint(len(text)) + text}.get(kind, b"")

    values = []
    for _ in range(3000):
        message = b"".join(field() for _ in range(rng.randint(0, 6)))
        values.append(message[: rng.randint(0, len(message))] if rng.random() < 0.3 else message)
    values += [bytes(rng.randrange(256) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    values += [b"\x08\x01" * 500, b"\x12" + varint(2**64 - 1) + b"rest", b"\x08" + b"\x80" * 9, b"\x08" + b"\x80" * 10, b"\x08" + b"\xff" * 12]
    rng.shuffle(values)
    for some in (values, values[:7], [b""], []):
        assert wire_json(some).to_pylist() == [json.dumps(read_wire(v)) for v in some]


def test_wire_walk_in_pieces(monkeypatch):
    values = [b"\x08" + varint(i) for i in range(300)] + [b"\x12" + varint(90) + b"y" * 90, b""]
    whole, errors = protobuf._without_schema(values)
    monkeypatch.setattr(protobuf, "WALKED_BYTES", 64)
    assert protobuf._without_schema(values)[0] == whole == [json.dumps(read_wire(v)) for v in values] and errors == [None] * 302
