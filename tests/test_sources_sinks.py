import json

import pytest
from pyspark.sql import functions as F

from topicwise.sinks import export, publish
from topicwise.sinks import session as sessions
from topicwise.sources.files import read_body, read_patches, read_session
from topicwise.operators.limits import stop_after
from topicwise.sources.kafka import (
    KafkaConfig,
    from_topics,
    in_ranges,
    lookup,
    planned_ranges,
    range_options,
    read_options,
    record_at,
    tail_start_offsets,
)


def test_config(tmp_path):
    assert KafkaConfig().options()["kafka.bootstrap.servers"] == "localhost:9092"
    (tmp_path / "c.json").write_text(json.dumps({
        "bootstrap_servers": "b:1", "security_protocol": "SASL_SSL", "sasl_mechanism": "SCRAM-SHA-256",
        "sasl_username": "u", "sasl_password": 'p"w', "ssl_cafile": "/ca.pem", "default_proto_dir": "x",
    }))
    options = KafkaConfig.from_file(tmp_path / "c.json").options(producer=True)
    assert options["kafka.client.id"] == "topicwise-producer"
    assert "ScramLoginModule" in options["kafka.sasl.jaas.config"] and 'password="p\\"w"' in options["kafka.sasl.jaas.config"]
    assert options["kafka.ssl.truststore.location"] == "/ca.pem"
    with pytest.raises(FileNotFoundError):
        KafkaConfig.from_file(tmp_path / "none.json")


def test_read_options():
    found = read_options("a, b")
    assert found["subscribe"] == "a,b" and found["startingOffsets"] == "latest" and found["includeHeaders"] == "true"
    assert read_options(["a"], from_beginning=True)["startingOffsets"] == "earliest"
    assert json.loads(read_options("a", partition=3)["assign"]) == {"a": [3]}
    marks = [{"topic": "a", "partition": 0, "beginning_offset": 5, "log_end_offset": 8},
             {"topic": "a", "partition": 1, "beginning_offset": 0, "log_end_offset": 100}]
    starts = tail_start_offsets(marks, 10)
    assert starts == {"a": {0: 5, 1: 90}}
    assert json.loads(read_options("a", tail_offsets=starts)["startingOffsets"]) == {"a": {"0": 5, "1": 90}}


MARKS = [{"topic": "a", "partition": 0, "beginning_offset": 5, "log_end_offset": 8},
         {"topic": "a", "partition": 1, "beginning_offset": 0, "log_end_offset": 100},
         {"topic": "b", "partition": 0, "beginning_offset": 7, "log_end_offset": 7}]


def test_planned_ranges():
    assert planned_ranges(MARKS) == {"a": {0: (5, 8), 1: (0, 100)}}
    assert planned_ranges(MARKS, tail=10) == {"a": {0: (5, 8), 1: (90, 100)}}
    assert planned_ranges(MARKS, first=6, last=6) == {"a": {0: (6, 7), 1: (6, 7)}}
    assert planned_ranges(MARKS, first=8, last=8) == {"a": {1: (8, 9)}}
    assert planned_ranges(MARKS, first=100) == planned_ranges(MARKS, tail=0) == planned_ranges([]) == {}
    options = range_options(planned_ranges(MARKS, last=6, tail=2), KafkaConfig("h:1"))
    assert options["kafka.bootstrap.servers"] == "h:1" and json.loads(options["assign"]) == {"a": [0]}
    assert json.loads(options["startingOffsets"]) == {"a": {"0": 6}} and json.loads(options["endingOffsets"]) == {"a": {"0": 7}}
    assert not {"subscribe", "maxOffsetsPerTrigger"} & options.keys()
    with pytest.raises(ValueError):
        range_options({})


def test_ranges_of_a_stored_log(spark, raw):
    log = raw(*[(t, p, o, o, None, b"x", []) for t in "ab" for p in range(2) for o in range(12)])
    found = {(r.topic, r.partition, r.offset) for r in in_ranges(log, planned_ranges(MARKS, last=6)).collect()}
    assert found == {("a", 0, 5), ("a", 0, 6), *[("a", 1, o) for o in range(7)]}
    assert in_ranges(log, {}).count() == 0


def test_stop_after(spark, raw, monkeypatch):
    rows = [(t, p, o, o, None, b"%d" % o, []) for t in "ab" for p in range(3) for o in range(0, 40, 2)] + [("a", 1, 6, 0, None, v, []) for v in (b"0", b"9", None)]
    log = raw(*rows).repartition(5)
    order = lambda r: (r[0], r[1], r[2], (r[3] is not None, r[3] or b""))
    expected = sorted(((r[0], r[1], r[2], r[5]) for r in rows), key=order)
    for heap in (100_000, 0):  # a top-k, block counts
        monkeypatch.setattr("topicwise.operators.limits.HEAP_LIMIT", heap)
        for n in (0, 1, 24, 25, 26, 27, 28, len(rows), 1000):
            got = [(r.topic, r.partition, r.offset, None if r.value is None else bytes(r.value)) for r in stop_after(log, n).collect()]
            assert sorted(got, key=order) == expected[:n], (heap, n)
    assert stop_after(log.limit(0), 3).count() == 0


def test_stored_log(spark, records):
    rows = records(*[("a" if i % 2 else "b", i % 3, i, i, None, b"x", []) for i in range(12)])
    assert from_topics(rows, "a,b").count() == 12 and from_topics(rows, "a", 1).count() == 2
    assert record_at(rows, "a", 1, 7).count() == 1
    wanted = spark.createDataFrame([("a", 1, 7), ("a", 1, 7), ("a", 0, 7)], "topic string, partition int, offset bigint")
    assert [r.offset for r in lookup(rows, wanted).collect()] == [7]


def test_key_file_goes_inline(tmp_path):
    (tmp_path / "c.pem").write_text("CERT")
    (tmp_path / "k.pem").write_text("KEY")
    options = KafkaConfig(ssl_certfile=str(tmp_path / "c.pem"), ssl_keyfile=str(tmp_path / "k.pem")).options()
    assert (options["kafka.ssl.keystore.certificate.chain"], options["kafka.ssl.keystore.key"]) == ("CERT", "KEY")
    assert "kafka.ssl.keystore.location" not in options


@pytest.fixture
def five(records):
    return records(*[
        ("tide.gauges", 0, i, 1_650_000_000_000 + 100 * i, f"g{i}".encode(), b'{"level": %d}' % i, [("x-source", b"t")])
        for i in range(5)
    ])


def test_session_round_trip(spark, five, tmp_path):
    path = str(tmp_path / "s.lens")
    assert sessions.write_session(five, path, max_messages=3) == 3
    assert sessions.write_session(five, path, recorded_ms=F.col("timestamp_ms")) == 5
    rows = read_session(spark, path).orderBy("offset").collect()
    assert [(r.offset, r.timestamp, r.key, r.headers) for r in rows] == [
        (i, 1_650_000_000_000 + 100 * i, f"g{i}", {"x-source": "t"}) for i in range(5)
    ]
    plan = publish.replay_plan(read_session(spark, path), target="copy", speed=2.0).orderBy("offset").collect()
    assert [round(r.delay_s, 6) for r in plan] == [0, 0.05, 0.05, 0.05, 0.05]
    assert [round(r.replay_at_s, 6) for r in plan] == [0, 0.05, 0.1, 0.15, 0.2]
    assert {r.topic for r in plan} == {"copy"} and all(r.published for r in plan)
    assert set(plan[0].headers) == {"x-source", "x-replayed-by", "x-replay-source-file"}
    still = publish.replay_plan(read_session(spark, path), speed=0.0, dry_run=True).collect()
    assert {(r.delay_s, r.topic, r.published) for r in still} == {(0.0, "tide.gauges", False)}


def test_session_reader(spark, tmp_path):
    (tmp_path / "a.lens").write_text('{"topic":"t","time_recorded_ms":1}\n\n  \n{"topic":"t","time_recorded_ms":9000,"value":"v"}\n')
    rows = publish.replay_plan(read_session(spark, str(tmp_path / "a.lens"))).orderBy("replay_at_s").collect()
    assert [(r.partition, r.offset, r.value, r.payload_format, r.is_dlq, r.delay_s) for r in rows] == [
        (0, 0, "", "raw", False, 0.0), (0, 0, "v", "raw", False, 5.0),
    ]
    assert rows[0].headers["x-replay-source-file"] == "a.lens"
    (tmp_path / "bad.lens").write_text('{"topic":')
    with pytest.raises(Exception):
        read_session(spark, str(tmp_path / "bad.lens")).collect()
    with pytest.raises(Exception):
        read_session(spark, str(tmp_path / "missing.lens"))


def test_bodies_and_patches(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n"a": 1}')
    assert read_body(spark, str(tmp_path / "m.json")).first().value == '{\n"a": 1}'
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "p.json").write_text('{"topic":"t","partition":0,"offset":1,"patched_payload":{"a":1}}\n')
    assert json.loads(read_patches(spark, str(tmp_path / "p")).first().patched_payload) == {"a": 1}


def test_templates(spark):
    rows = publish.message_template(spark, "t", '{"a":1}', "k", "x-a: 1 , bare", 3).orderBy("copy").collect()
    assert [(r.key, r.value, r.headers) for r in rows] == [(f"k_{i}", '{"a":1}', {"x-a": "1"}) for i in (1, 2, 3)]
    single = publish.as_messages(publish.message_template(spark, "t", key="k")).first()
    assert (bytes(single.key), bytes(single.value), single.headers) == (b"k", b"{}", None)


def test_publish_to_files(spark, five, tmp_path):
    from topicwise.operators.redrive import plan_redrive

    publish.publish_to_files(plan_redrive(five, target="out"), str(tmp_path / "out"))
    publish.publish_to_files(plan_redrive(five), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.columns == ["topic", "key", "value", "headers"] and rows.count() == 5


def test_exports(spark, records, tmp_path):
    rows = records(
        ("t", 1, 2, 5, b'k"1', b'{"b":"x,\\"y\\"","a":1}', [("h", b"v")]),
        ("t.dlq", 0, 1, 6, None, b"two\nlines", []),
        ("t", 0, 9, 7, b"k", None, []),
    )
    export.export(rows, str(tmp_path / "json"))
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "json").glob("part-*")) if p.stat().st_size)
    found = json.loads(text)
    assert [(r["topic"], r["offset"]) for r in found] == [("t", 9), ("t", 2), ("t.dlq", 1)]
    assert found[1]["payload"] == {"a": 1, "b": 'x,"y"'} and found[1]["headers"] == {"h": "v"} and found[0]["payload"] is None
    export.export(rows, str(tmp_path / "nd"), "ndjson", dlq_only=True)
    lines = [line for p in (tmp_path / "nd").glob("part-*") for line in p.read_text().splitlines()]
    assert [json.loads(line)["payload"] for line in lines] == ["two\nlines"]
    export.export(rows, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(str(tmp_path / "csv"))
    assert tuple(back.columns) == export.CSV_COLUMNS
    assert {(r.Key, r.Payload) for r in back.collect()} == {('k"1', '{"a":1,"b":"x,\\"y\\""}'), (None, "two\nlines"), ("k", None)}
    export.export(rows.filter("false"), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == []
