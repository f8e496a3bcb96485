import random

import pytest
from pyspark.sql import functions as F

from topicwise.operators import trace, views
from topicwise.operators.limits import recent, tail_n
from topicwise.operators.sequence import follow, running_delay


@pytest.fixture(scope="module")
def lifecycle(records):
    return records(
        ("meter.bills", 2, 31, 7450, b"p", b'{"event_type":"BillSent","order_id":"run_77k"}', []),
        ("meter.reads", 1, 14, 7000, b"o", b'{"event_type":"ReadTaken","order_id":"run_77k"}', []),
        ("weather", 0, 8, 7100, b"u", b'{"event_type":"Rain","order_id":"run_12z"}', []),
        ("meter.bills.dlq", 3, 2, 7525, b"d", b'{"order_id":"run_77k"}', [("x-exception-message", b"tariff table is gone since May")]),
    )


def test_hops_and_summary(lifecycle):
    hops = trace.trace_hops(lifecycle, "RUN_77K")
    rows = hops.orderBy("step").collect()
    assert [(r.topic, r.latency_ms, r.status) for r in rows] == [
        ("meter.reads", None, "OK"), ("meter.bills", 450.0, "OK"), ("meter.bills.dlq", 75.0, "DLQ_POISON"),
    ]
    total = trace.trace_summary(hops).first()
    assert (total.hops, total.total_latency_ms, total.has_dlq) == (3, 525.0, True)
    assert total.topics == ["meter.reads", "meter.bills", "meter.bills.dlq"]
    shown = {r.step: (r.position, r.event, r.delta, r.status) for r in views.hop_view(hops).collect()}
    assert shown[1] == ("1:14", "ReadTaken", "START", "SUCCESS")
    assert shown[3] == ("3:2", "tariff table is gone", "+75 ms", "POISON (DLQ)")


def test_matching(records):
    rows = records(
        ("t", 0, 1, 1, None, b"x", [("x-correlation-id", b"call-40417-q")]),
        ("t", 0, 2, 1, None, b'{"order_id":"run_8830","litres":3}', []),
        ("t", 0, 3, 1, None, b'{"order_id":8830,"customer_id":null}', []),
        ("t", 0, 4, 1, None, b'["run_8830"]', [("X-Correlation-Id", b"40417")]),
    )

    def hit(correlation_id):
        return sorted(r.offset for r in rows.filter(trace.matches_correlation(correlation_id)).collect())

    assert hit("40417") == [1] and hit("8830") == [2, 3] and hit("nobody") == [] and hit("none") == []


def test_total_needs_two_known_times(records):
    rows = records(("t", 0, 1, 0, b"a", b"x", []), ("t", 0, 2, 50, b"a", b"x", []), ("t", 0, 1, 7, b"b", b"x", []))
    totals = {r.correlation_id: r.total_latency_ms for r in trace.trace_summary(rows.withColumn("correlation_id", F.col("key"))).collect()}
    assert totals == {"a": None, "b": None}


def sequence_rows(spark, n=600):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        ts = rng.choice([None, 0, -5, rng.randrange(-3000, 3000), rng.randrange(0, 200_000)])
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
        rows.append((key, rng.choice("ab"), rng.randrange(2), i * 1000, ts))
    return rows, spark.createDataFrame(rows, "k string, topic string, partition int, offset bigint, ts bigint")


@pytest.mark.parametrize("keys", [["k"], []])
def test_follow_equals_brute_force(spark, monkeypatch, keys):
    from topicwise.operators import sequence

    monkeypatch.setattr(sequence, "BUCKET_OFFSETS", 50_000)
    rows, df = sequence_rows(spark)
    expected, last, count = {}, {}, {}
    for k, topic, p, off, ts in sorted(rows, key=lambda r: (r[4] or 0, r[3], r[1], r[2])):
        g = k if keys else ""
        count[g] = count.get(g, 0) + 1
        expected[off] = (last.get(g), count[g])
        last[g] = ts
    for bucket_ms in (700, 60_000, None):
        found = {r.offset: (r.prev, r.step) for r in follow(df, keys, "ts", "prev", "step", bucket_ms).collect()}
        assert found == expected


def test_running_delay_equals_brute_force(spark):
    rows, df = sequence_rows(spark, 300)

    def pause(previous, current):
        known = previous.isNotNull() & current.isNotNull()
        return F.when(known, F.least(F.lit(5.0), F.greatest(F.lit(0), current - previous) / F.lit(1000.0))).otherwise(0.0)

    expected, before, at = {}, None, 0.0
    for i, (_, topic, p, off, ts) in enumerate(sorted(rows, key=lambda r: (r[4] or 0, r[3], r[1], r[2]))):
        delay = 0.0 if i == 0 or before is None or ts is None else min(5.0, max(0, ts - before) / 1000)
        at += delay
        expected[off] = (round(delay, 6), round(at, 6))
        before = ts
    for bucket_ms in (500, 60_000):
        found = {r.offset: (round(r.delay_s, 6), round(r.at_s, 6)) for r in running_delay(df, "ts", pause, bucket_ms).collect()}
        assert found == expected


def test_many_ids_equal_single_ids(spark, records, monkeypatch):
    rng = random.Random(3)
    rows = records(
        *[
            ("t", 0, i, i, f"key-{rng.randrange(30)}".encode(), f'{{"order_id":"ord_{rng.randrange(120)}"}}'.encode(), [])
            for i in range(150)
        ]
    ).cache()
    ids = ["ORD_1", "ord_11", "Y-2", "key-29", "ord_", "absent"]
    table = spark.createDataFrame([(i,) for i in ids + ["", None, "ord_11"]], "correlation_id string")
    expected = {(i, r.offset) for i in ids for r in rows.filter(trace.matches_correlation(i)).collect()}
    for limit in (200_000, 0):
        monkeypatch.setattr(trace, "BROADCAST_IDS", limit)
        assert {(r.correlation_id, r.offset) for r in trace.pair_with_ids(rows, table).collect()} == expected
        found = trace.pair_with_ids(rows, table).count()
        assert found == len(expected)
        whole = {(i, o) for i, o in expected if i == "key-29" or i == "ord_11"}
        exact = {(r.correlation_id, r.offset) for r in trace.pair_with_ids(rows, table, exact=True).collect()}
        assert exact <= whole | {(i, o) for i, o in expected if i == "ORD_1"} and exact


def test_tail_and_recent(spark, monkeypatch):
    from topicwise.operators import limits

    rows = spark.range(4000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'big' ELSE concat('t', id % 5) END topic", "cast(id % 2 as int) partition", "id * id offset",
        "id timestamp_ms", "id % 4 = 0 is_dlq",
    ).cache()
    expected = {}
    for r in rows.collect():
        expected.setdefault((r.topic, r.partition), []).append(r.offset)
    for n in (3, 100):
        wanted = {(k, o) for k, v in expected.items() for o in sorted(v)[-n:]}
        for limit in (1_000, 0):
            monkeypatch.setattr(limits, "GROUP_LIMIT", limit)
            assert {((r.topic, r.partition), r.offset) for r in tail_n(rows, n).collect()} == wanted
    assert [r.timestamp_ms for r in recent(rows, 3, dlq_only=True).collect()] == [3996, 3992, 3988]
