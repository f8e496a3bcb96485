import pytest
from pyspark.sql import functions as F

from topicwise.functions.payload import json_num, json_text, json_truthy, strict_json
from topicwise.functions.text import ellipsis, exception_class, parse_header_text
from topicwise.operators import views
from topicwise.operators.filters import dlq_only, filter_events, keyword_filter


@pytest.fixture(scope="module")
def orders(records):
    return records(
        ("tank.log", 0, 1, 1, b"tk_1", b'{"unit":"litre","volume":31}', []),
        ("tank.log", 0, 2, 1, b"tk_2", b'{"unit":"litre","volume":7}', []),
        ("tank.log", 0, 3, 1, b"tk_3", b'{"unit":"gallon","volume":44}', []),
        ("tank.log", 0, 4, 1, b"tk_4", b'{"tank":"t","state":"VOIDED"}', []),
        ("tank.log", 0, 5, 1, b"tk_FAIL_41", b'{"tank":"t"}', []),
        ("tank.log", 0, 6, 1, b"tk_6", b"plain", [("x-error", b"FAILED_SEAL")]),
        ("tank.log", 0, 7, 1, b"tk_7", b'{"unit":"litre","volume":"31.5"}', []),
        ("tank.log", 0, 8, 1, b"tk_special_8", b'{"unit":"gallon","flag":0}', []),
    )


def offsets(df):
    return sorted(r.offset for r in df.collect())


def test_no_rule_keeps_all(orders):
    assert offsets(filter_events(orders)) == list(range(1, 9))


def test_predicate(orders):
    litre = (json_text("payload", "$.unit") == "litre") & (json_num("payload", "$.volume") > 20)
    assert offsets(filter_events(orders, litre)) == [1]
    assert offsets(filter_events(orders, "headers['x-error'] IS NOT NULL")) == [6]
    assert filter_events(orders, litre).columns == orders.columns


def test_regex_in_payload_key_and_header(orders):
    assert offsets(filter_events(orders, regex="fail|VOIDED")) == [4, 5, 6]
    assert offsets(filter_events(orders, regex="x-error:failed")) == [6]


def test_both_rules(orders):
    gallon = json_text("payload", "$.unit") == "gallon"
    assert offsets(filter_events(orders, gallon, "special")) == [8]


def test_truthiness(spark):
    docs = ["", '{"a":""}', '{"a":[]}', '{"a":{}}', '{"a":0}', '{"a":0.0}', '{"a":false}', '{"a":null}', "{}"]
    good = ['{"a":"0"}', '{"a":[0]}', '{"a":-1}', '{"a":true}']
    df = spark.createDataFrame([(d,) for d in docs + good], "d string").select("d", strict_json("d").alias("p"))
    assert [r.d for r in df.filter(json_truthy("p", "$.a")).collect()] == good


def test_predicate_on_scalar_value(records):
    rows = records(("t", 0, 1, 1, None, b"123", []), ("t", 0, 2, 1, None, b"x", []))
    assert offsets(filter_events(rows, "try_variant_get(payload, '$', 'int') > 100")) == [1]


def test_keyword_and_dlq(orders):
    assert offsets(keyword_filter(orders, "UNIT\":\"gallon")) == [3, 8]
    assert offsets(keyword_filter(orders, "")) == list(range(1, 9))
    assert offsets(dlq_only(orders)) == []


def test_views(records):
    rows = records(
        ("t", 1, 5, 1700, b"k", b'{"b":1,"a":"' + b"x" * 80 + b'"}', []),
        ("t.dlq", 0, 6, 0, None, None, []),
        ("t", 0, 7, 9, b"k", b"{}", [("x-exception-message", b"E" * 31)]),
    )
    table = {r.offset: r for r in views.table_view(rows).collect()}
    assert table[5].preview == '{"a":"' + "x" * 51 + "..." and len(table[5].preview) == 60
    assert tuple(table[6]) == ("DLQ", 0, 6, "-", "null", "", "-")
    assert {r.line for r in views.raw_view(rows).collect()} >= {"[0:6] None", "[0:7] {}"}
    listed = {r.offset: r.error for r in views.dlq_list_view(rows).collect()}
    assert listed[6] == "Unknown failure" and listed[7] == "E" * 27 + "..."
    assert {r.offset: r.payload for r in views.summary_view(rows).collect()}[7] == "{}"


def test_text_functions(spark):
    row = spark.range(1).select(
        parse_header_text(F.lit(" a : 1:2 ,bare,b:,a:3")).alias("h"),
        exception_class(F.lit("at x\njava.net.SocketTimeoutException: y")).alias("e"),
        exception_class(F.lit("fine")).alias("none"),
        ellipsis(F.lit("x" * 40), 40).alias("kept"),
    ).first()
    assert row.h == {"a": "3", "b": ""}
    assert (row.e, row.none, row.kept) == ("SocketTimeoutException", None, "x" * 40)


def test_regex_folds_letters_of_any_script(records):
    from topicwise.functions.text import exception_class
    from topicwise.operators.filters import matches_regex

    rows = records(("t", 0, 0, 1, "ÉCLAIR".encode(), b"{}", []), ("t", 0, 1, 1, b"other", b"{}", []))
    assert [r.offset for r in rows.filter(matches_regex("éclair")).collect()] == [0]
    from pyspark.sql import functions as F

    assert rows.limit(1).select(exception_class(F.lit("at ÜberException: x"))).first()[0] == "ÜberException"


def test_throughput_counts_records_without_a_time(records):
    from topicwise.operators.stats import throughput

    rows = records(("t", 0, 0, 1500, None, b"{}", []), ("t", 0, 1, None, None, b"{}", []), ("t", 0, 2, -1, None, b"{}", []))
    found = {r.window_start_ms: r.events for r in throughput(rows).collect()}
    assert found == {1000: 1, None: 1, -1000: 1}


def test_json_array_with_repeated_first_record(records):
    import json

    from topicwise.sinks.export import json_array_lines

    one = ("t", 0, 0, 1, b"k", b'{"a":1}', [])
    lines = [r.line for r in json_array_lines(records(one, one, ("t", 0, 1, 1, b"k", b"{}", []))).collect()]
    assert [r["offset"] for r in json.loads("\n".join(lines))] == [0, 0, 1]


def test_redrive_limit_counts_records(records):
    from topicwise.operators.redrive import redrive_batch

    one = ("t.dlq", 0, 0, 1, b"k", b'{"a":1}', [("x-original-topic", b"t")])
    plan, summary = redrive_batch(records(one, one, one), limit=2, dry_run=True)
    assert plan.count() == summary.first().matched_count == 2


def test_many_ids_alike_on_both_ways(spark, records, monkeypatch):
    from topicwise.operators import trace

    one = ("t", 0, 0, 1, b"id-7", b'{"a":1}', [])
    rows = records(one, one, ("t", 0, 1, 1, b"id-9", b"{}", []))
    ids = spark.createDataFrame([("id-7",), ("id-9",)], "correlation_id string")
    few = sorted((r.offset, r.correlation_id) for r in trace.pair_with_ids(rows, ids).collect())
    monkeypatch.setattr(trace, "BROADCAST_IDS", 0)
    assert few == sorted((r.offset, r.correlation_id) for r in trace.pair_with_ids(rows, ids).collect()) == [(0, "id-7"), (0, "id-7"), (1, "id-9")]
