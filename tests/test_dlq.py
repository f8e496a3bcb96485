import pytest

from topicwise.functions.payload import json_num
from topicwise.operators import dlq, redrive
from topicwise.operators.limits import nth_position


def h(**values):
    return [(k.replace("_", "-"), v.encode()) for k, v in values.items() if v is not None]


def dead(offset, partition=0, message=None, target="order.events", payload=b"{}", **more):
    headers = h(x_exception_message=message, x_original_topic=target, **more)
    return ("order.events.dlq", partition, offset, 1, b"k", payload, headers)


@pytest.mark.parametrize(
    "message, category, kind",
    [
        ("JsonParseException: bad", "Deserialization Syntax Error", "JsonParseException"),
        ("json.JSONDecodeError: bad", "Deserialization Syntax Error", "JSONDecodeError"),
        ("ConstraintViolationException", "Schema Validation Failure", "ConstraintViolationException"),
        ("google.protobuf.DecodeError", "Protobuf Deserialization Failure", "DecodeError"),
        ("connectionrefused by host", "Downstream Service Outage", None),
        ("order 15037 lost", "Downstream Service Outage", None),
        ("OptimisticLockException", "Idempotency or Conflict Rejection", "OptimisticLockException"),
        ("KeyError: 'id'", "Uncaught Null / Key Exception", "KeyError"),
        ("Boom", "Unclassified Error", None),
    ],
)
def test_diagnosis(records, message, category, kind):
    row = dlq.diagnose(records(dead(1, message=message))).first()
    assert (row.failure_category, row.exception_type, row.exception_message) == (category, kind, message)


def test_diagnosis_sources(records):
    rows = dlq.diagnose(
        records(
            dead(1, x_original_partition="2", x_original_offset="100", message="x"),
            dead(2, x_original_partition="-2", x_original_offset="1a", message="", x_exception_stacktrace="at TimeoutException"),
            ("t.dlq", 0, 3, 1, None, b"{}", [("deadletter.reason", b"ValidationException")]),
        )
    ).orderBy("offset").collect()
    assert (rows[0].original_partition, rows[0].original_offset, rows[0].root_cause) == (2, 100, "x")
    assert (rows[1].original_partition, rows[1].original_offset) == (None, None)
    assert (rows[1].failure_category, rows[1].exception_message) == ("Downstream Service Outage", None)
    assert (rows[2].failure_category, rows[2].original_topic) == ("Schema Validation Failure", None)
    empty = dlq.diagnose(records(("t.dlq", 0, 3, 1, None, b"{}", []))).first()
    assert empty.root_cause == "Unknown error occurred during processing."


def test_plan(spark, records):
    rows = records(
        dead(1, message="m", trace="a"),
        dead(2, message="m", target=None),
        ("t.dlq", 1, 3, 1, None, None, [("X-Death", b"1"), ("x-redriven-by", b"someone")]),
    )
    plan = {r.source_offset: r for r in redrive.plan_redrive(rows).collect()}
    sent = {x.key: bytes(x.value).decode() for x in plan[1].headers}
    assert sent == {
        "trace": "a", "x-redriven-by": "topicwise", "x-redrive-source-topic": "order.events.dlq", "x-redrive-source-offset": "1",
    }
    assert (plan[1].topic, bytes(plan[1].key), bytes(plan[1].value)) == ("order.events", b"k", b"{}")
    assert not plan[2].success and "unspecified" in plan[2].error
    assert plan[3].value is None and {x.key for x in plan[3].headers} == {
        "x-redriven-by", "x-redrive-source-topic", "x-redrive-source-offset",
    }
    patches = spark.createDataFrame([("order.events.dlq", 0, 1, "new")], "topic string, partition int, offset bigint, patched_payload string")
    patched = {r.source_offset: bytes(r.value or b"") for r in redrive.plan_redrive(redrive.with_patches(rows, patches), "to").collect()}
    assert patched == {1: b"new", 2: b"{}", 3: b""}
    kept = redrive.plan_redrive(rows, "to", strip=False).filter("source_offset = 1").first()
    assert "x-exception-message" in {x.key for x in kept.headers}


@pytest.fixture(scope="module")
def batch(records):
    def doc(total):
        return b'{"tank":"T","again":true,"total":%d}' % total

    return records(
        dead(31, message="TimeoutException: no answer", payload=doc(12)),
        dead(37, message="JsonParseException: odd brace", payload=doc(130)),
        dead(44, 2, message="ConnectionRefusedError: gauge 503", payload=doc(180)),
        dead(52, 2, target=None, payload=doc(640)),
    )


def counts(summary):
    r = summary.first()
    return (r.total_scanned, r.matched_count, r.redriven_count, r.skipped_count, r.failed_count)


def test_batch_counts(batch):
    plan, summary = redrive.redrive_batch(batch, dry_run=True)
    assert counts(summary) == (4, 3, 3, 1, 0) and summary.first().target_topic == "order.events"
    assert {(r.produced_partition, r.produced_offset) for r in plan.collect()} == {(0, 31), (0, 37), (2, 44)}
    assert counts(redrive.redrive_batch(batch, category="outage")[1]) == (4, 2, 2, 2, 0)
    big = json_num("payload", "$.total") > 100
    assert counts(redrive.redrive_batch(batch, predicate=big)[1]) == (4, 2, 2, 2, 0)


def test_batch_limit(batch):
    plan, summary = redrive.redrive_batch(batch, target="other", limit=1)
    assert counts(summary) == (4, 1, 1, 0, 0) and summary.first().target_topic == "other"
    assert [(r.topic, r.source_offset, r.produced_offset) for r in plan.collect()] == [("other", 31, None)]
    assert counts(redrive.redrive_batch(batch, category="outage", limit=2)[1]) == (4, 2, 2, 1, 0)
    assert counts(redrive.redrive_batch(batch, category="outage", limit=9)[1]) == (4, 2, 2, 2, 0)
    assert counts(redrive.redrive_batch(batch.filter("false"))[1])[:2] == (0, 0)


def test_nth_position_by_blocks(spark, monkeypatch):
    from topicwise.operators import limits

    rows = spark.range(5000).selectExpr("concat('t', id % 2) topic", "cast(id % 3 as int) partition", "id * 7 offset")
    ordered = [tuple(r) for r in rows.orderBy("topic", "partition", "offset").collect()]
    monkeypatch.setattr(limits, "HEAP_LIMIT", 10)
    monkeypatch.setattr(limits, "BLOCK", 500)
    for n in (11, 833, 2500, 5000, 9000):
        assert tuple(nth_position(rows, n).first().cutoff) == ordered[min(n, 5000) - 1]


def test_ledger_and_source(spark, records):
    rows = records(dead(1, message="m", x_original_partition="0", x_original_offset="9"), dead(2, message="m"))
    ledger = spark.createDataFrame([("order.events.dlq", 0, 1)], "topic string, partition int, offset bigint")
    assert [r.offset for r in redrive.already_sent(rows, ledger).collect()] == [2]
    source = records(("order.events", 0, 9, 77, None, b'{"from":1}', []))
    linked = dlq.link_source(dlq.diagnose(rows), source).orderBy("offset").select("source_value", "source_timestamp_ms").collect()
    assert [tuple(r) for r in linked] == [('{"from":1}', 77), (None, None)]


def test_inspect(records):
    rows = records(*[dead(i, i % 2, message="m") for i in range(6)])
    assert [(r.partition, r.offset) for r in dlq.inspect(rows, 4).collect()] == [(0, 0), (0, 2), (0, 4), (1, 1)]
    assert "failure_category" not in dlq.inspect(rows, 4, rules=None).columns


def test_small_limit_of_a_batch_is_one_scan(records):
    letters = [dead(2, 0, "TimeoutException", payload=p) for p in (b"{}", b'{"b":1}', b'{"a":1}')]
    batch = records(*letters, dead(1, 1, "TimeoutException"), dead(1, 0, "Boom"))
    for limit, values in ((1, [b'{"a":1}']), (2, [b'{"a":1}', b'{"b":1}']), (4, [b'{"a":1}', b'{"b":1}', b"{}", b"{}"])):
        plan = redrive.redrive_batch(batch, category="outage", limit=limit)[0]
        assert [bytes(r["value"]) for r in plan.orderBy("source_partition", "value").collect()] == values
        assert "subquery" not in plan._jdf.queryExecution().toString().lower()
    many = redrive.redrive_batch(batch, category="outage", limit=5000)[0]
    assert many.count() == 4
