import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from topicwise.operators.decode import to_records
from topicwise.operators.limits import recent
from topicwise.operators.trace import trace_summary
from topicwise.schemas import RAW
from topicwise.sources.files import read_session
from topicwise.streaming import latency, live
from topicwise.streaming.tables import MergedTable


@pytest.fixture(scope="module")
def log(spark, raw, tmp_path_factory):
    """Two files of RAW records; a stream reads one per micro-batch."""
    path = str(tmp_path_factory.mktemp("log"))
    for part in range(2):
        raw(*[
            ("t.dlq" if i % 5 == 0 else "t", i % 2, i, 1_700_000_000_000 + 400 * i, f"k{i}".encode(), b'{"n":%d}' % i,
             [("x-correlation-id", f"c{i % 3}".encode())])
            for i in range(part * 20, part * 20 + 20)
        ]).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture
def stream(spark, log):
    return lambda: to_records(spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(log), wire=False)


def test_tail_alerts_and_capture(spark, stream, tmp_path):
    live.append_to(live.dlq_alerts(stream()), f"{tmp_path}/a", f"{tmp_path}/ca").awaitTermination()
    alerts = spark.read.parquet(f"{tmp_path}/a")
    assert alerts.count() == 8 and alerts.filter("offset = 5").first().alert == "Poison Pill detected on t.dlq [P:1 Offset:5]!"
    live.append_to(live.tail(stream(), regex="k1[0-9]"), f"{tmp_path}/t", f"{tmp_path}/ct").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t").count() == 10
    assert live.record_stream(stream(), f"{tmp_path}/s", f"{tmp_path}/cs", available_now=True) == 40
    assert read_session(spark, f"{tmp_path}/s").count() == 40
    assert live.record_stream(stream(), f"{tmp_path}/m", f"{tmp_path}/cm", max_messages=25, available_now=True) == 25
    lines = [r.offset for r in read_session(spark, f"{tmp_path}/m").collect()]
    assert len(lines) == 25 and live.record_stream(stream(), f"{tmp_path}/m", f"{tmp_path}/cm", max_messages=25, available_now=True) == 25
    assert live.record_stream(stream(), f"{tmp_path}/m", f"{tmp_path}/lost", max_messages=25, available_now=True) == 25
    assert sorted(r.offset for r in read_session(spark, f"{tmp_path}/m").collect()) == sorted(lines)
    assert live.record_stream(stream(), f"{tmp_path}/d", f"{tmp_path}/cd", duration_seconds=0.0) >= 0


def test_throughput_equals_batch(spark, stream, tmp_path):
    live.keep_throughput(stream(), f"{tmp_path}/w", f"{tmp_path}/c", every=1).awaitTermination()
    found = {r.window_start_ms: r.events for r in live.read_throughput(spark, f"{tmp_path}/w").collect()}
    expected = {}
    for i in range(40):
        second = (1_700_000_000_000 + 400 * i) // 1000 * 1000
        expected[second] = expected.get(second, 0) + 1
    assert found == expected
    assert live.read_throughput(spark, f"{tmp_path}/nothing").count() == 0


def test_merged_table_stays_small(spark, tmp_path):
    table = MergedTable(f"{tmp_path}/t", "k string, n bigint", ["k"], {"n": F.sum}, every=3)
    for number in range(20):
        rows = spark.createDataFrame([("a", 1), (f"b{number % 2}", 10), (None, 2)], "k string, n bigint")
        table.add(rows, number)
        table.add(rows, number)  # repeated after a failure
        assert len([f for f in os.listdir(f"{tmp_path}/t") if "-" in f]) <= 9
        if number == 11:
            assert dict(table.rows(spark, before=11).collect()) == {"a": 11, "b0": 60, "b1": 50, None: 22}
    assert dict(table.rows(spark).collect()) == {"a": 20, "b0": 100, "b1": 100, None: 40}
    with pytest.raises(ValueError, match="another checkpoint"):
        table.add(rows, 4)
    os.remove(f"{tmp_path}/t/batch-{19:09d}/_SUCCESS")  # not written to its end: no part of the table
    assert dict(table.rows(spark).collect())["a"] == 19


def test_recent_equals_batch(spark, log, stream, tmp_path):
    live.keep_recent(stream(), f"{tmp_path}/r", f"{tmp_path}/c", 25).awaitTermination()
    batch = recent(to_records(spark.read.parquet(log)), 25)
    assert {r.offset for r in live.read_recent(spark, f"{tmp_path}/r").collect()} == {r.offset for r in batch.collect()}


def trace_id():
    return F.expr("headers['x-correlation-id']")


def test_live_hops_go_on_after_a_batch(spark, stream, tmp_path, monkeypatch):
    for name, limit in (("h", latency.BROADCAST_TRACES), ("s", 0)):
        monkeypatch.setattr(latency, "BROADCAST_TRACES", limit)
        latency.keep_hops(stream(), trace_id(), f"{tmp_path}/{name}", f"{tmp_path}/c{name}", every=1).awaitTermination()
        rows = latency.read_hops(spark, f"{tmp_path}/{name}").orderBy("correlation_id", "step").collect()
        assert len(rows) == 40
        for r in rows:
            assert r.offset == int(r.correlation_id[1]) + 3 * (r.step - 1)
            assert r.latency_ms == (None if r.step == 1 else 1200.0)
    assert latency.read_hops(spark, f"{tmp_path}/nothing").count() == 0


def test_live_hops_decode_a_batch_once(spark, stream, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(ms):
        read.add(1)
        return ms

    hops = stream().withColumn("timestamp_ms", counted("timestamp_ms"))
    latency.keep_hops(hops, trace_id(), f"{tmp_path}/h", f"{tmp_path}/c").awaitTermination()
    assert latency.read_hops(spark, f"{tmp_path}/h").count() == read.value == 40
    assert spark.read.parquet(f"{tmp_path}/h/arrived").count() == 20


def _as_stream(spark, raw, path, *parts):
    """Each part as one more run of a stream on a growing folder."""
    for part in parts:
        raw(*part).coalesce(1).write.mode("append").parquet(path)
        yield to_records(spark.readStream.schema(RAW).parquet(path), wire=False)


def test_live_hops_late_timeless_and_forgotten(spark, raw, tmp_path):
    def hop(offset, ms, trace="a"):
        return ("t", 0, offset, ms, b"k", b"{}", [("x-correlation-id", trace.encode())])

    parts = [hop(1, 5000), hop(2, 6000), hop(9, 100, "b")], [hop(3, 4000), hop(4, None), hop(8, 1, "")], [hop(5, 7000)]
    found = {}
    for ttl in (latency.DAY_MS, 0):
        path = f"{tmp_path}/{ttl}"
        for log in _as_stream(spark, raw, f"{path}/log", *parts):
            latency.keep_hops(log, trace_id(), f"{path}/h", f"{path}/c", ttl_ms=ttl).awaitTermination()
        rows = latency.read_hops(spark, f"{path}/h").filter("correlation_id = 'a'")
        found[ttl] = {r.offset: (r.step, r.latency_ms) for r in rows.collect()}
    # The record without a time comes first in its batch; nothing is known of it, and the next hop follows it.
    assert found[latency.DAY_MS] == {1: (1, None), 2: (2, 1000.0), 4: (3, None), 3: (4, None), 5: (5, 3000.0)}
    assert found[0] == {1: (1, None), 2: (2, 1000.0), 4: (1, None), 3: (2, None), 5: (1, None)}


def test_live_trace_summary_counts_late_hops(spark, raw, tmp_path):
    def hop(topic, offset, ms, trace="a"):
        return (topic, 0, offset, ms, b"k", b"{}", [("x-correlation-id", trace.encode())])

    parts = [
        [hop("late", 1, 9000), hop("b.dlq", 2, 5000), hop("x", 1, 50, "one")],
        [hop("first", 7, 1000), hop("late", 2, 3000)],
        [hop("z", 1, None, "zero"), hop("z", 2, 8000, "zero"), hop("z", 3, 1, "")],
    ]
    for log in _as_stream(spark, raw, f"{tmp_path}/log", *parts):
        live.keep_trace_summary(log, trace_id(), f"{tmp_path}/s", f"{tmp_path}/c", every=1).awaitTermination()
    found = live.read_trace_summary(spark, f"{tmp_path}/s")
    whole = trace_summary(to_records(spark.read.parquet(f"{tmp_path}/log"), wire=False).withColumn("correlation_id", trace_id()).filter("correlation_id <> ''"))
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.select(*found.columns).collect()))
    by_id = {r.correlation_id: r for r in found.collect()}
    assert by_id["a"].topics == ["first", "late", "b.dlq"] and by_id["a"].total_latency_ms == 8000.0 and by_id["a"].has_dlq
    assert by_id["zero"].total_latency_ms is None and by_id["one"].hops == 1


def test_lag_from_progress():
    source = {"description": "KafkaV2[Subscribe[t]]", "startOffset": {"t": {"0": 3, "1": 0}}, "endOffset": {"t": {"0": 10}}, "latestOffset": '{"t":{"0":25,"1":4,"2":2}}'}
    progress = {"batchId": 7, "sources": [source, {"description": "FileStreamSource", "endOffset": {"logOffset": 3}, "latestOffset": None}]}
    rows = live.progress_lag(progress, "g")
    assert [(r["group_id"], r["partition"], r["log_end_offset"], r["current_offset"], r["lag"]) for r in rows] == [
        ("g", 0, 25, 10, 15), ("g", 1, 4, 0, 4), ("g", 2, 2, 0, 2)]
    assert live.progress_lag({"sources": []}) == live.progress_lag({}) == []
    seen = []
    listener = live.LagListener(lambda rows, number: seen.append((number, len(rows))))
    for p in (progress, {"batchId": 8, "sources": []}):
        listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(json=json.dumps(p))))
    assert seen == [(7, 3)]


def test_lag_refresh(spark, stream, tmp_path):
    def committed(session):
        return session.createDataFrame([("g", "t", 0, 30)], "group_id string, topic string, partition int, committed_offset bigint")

    def write(rows, number):
        rows.write.parquet(f"{tmp_path}/lag/{number}")

    live.refresh_lag(stream(), committed, write, f"{tmp_path}/c", "g", every=None).awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/lag/1").filter("topic = 't'").orderBy("partition").collect()
    assert [(r.log_end_offset, r.current_offset, r.lag) for r in last] == [(39, 30, 9), (40, 0, 40)]
