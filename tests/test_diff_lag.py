import pytest

from topicwise.functions.payload import strict_json
from topicwise.operators import diff, lag, stats

PAIRS = [
    ('{"basin":"north","level":7.25,"gates":[4,9]}', '{"basin":"north","level":7.25,"gates":[4,9]}', set()),
    ('{"q":3,"sluice":true}', '{"q":3,"weir":null}', {("sluice", "removed", "true", None), ("weir", "added", None, "null")}),
    ('{"pump":{"maker":"Ada","state":"idle"}}', '{"pump":{"maker":"Ada","state":"run"}}',
     {("pump.state", "modified", '"idle"', '"run"')}),
    ('{"l":[1,2]}', '{"l":[1,3]}', {("l", "modified", "[1,2]", "[1,3]")}),
    ('{"a":{"b":1}}', '{"a":5}', {("a", "modified", '{"b":1}', "5")}),
    ('{"a":null}', "{}", {("a", "removed", "null", None)}),
    ('{"a":null}', '{"a":null}', set()),
    ("{}", '{"a":{"b":{"c":1}}}', {("a", "added", None, '{"b":{"c":1}}')}),
    ("5", "6", {("value", "modified", "5", "6")}),
    ("abc", '"abc"', set()),
    (None, "null", set()),
    ("[1]", '{"a":1}', {("value", "modified", "[1]", '{"a":1}')}),
    ('{"a":1,"b":100,"c":9007199254740993}', '{"a":1.0,"b":1e2,"c":9007199254740992}',
     {("c", "modified", "9007199254740993", "9007199254740992")}),
    ('{"a":true}', '{"a":1}', set()),
    ('{"a":{"b":{"c":{"d":1}}}}', '{"a":{"b":{"c":{"d":2}}}}', {("a.b.c.d", "modified", "1", "2")}),
]


@pytest.mark.parametrize("as_variant", [False, True])
def test_items_and_summary(spark, as_variant):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], "pair_id int, a string, b string")
    if as_variant:
        df = df.filter("pair_id NOT IN (9, 10)").select("pair_id", strict_json("a").alias("a"), strict_json("b").alias("b"))
    found = {}
    for r in diff.diff_payloads(df).collect():
        found.setdefault(r.pair_id, set()).add((r.path, r.diff_type, r.old_value, r.new_value))
    expected = {i: d for i, (_, _, d) in enumerate(PAIRS) if d}
    assert found == expected
    for r in diff.diff_summary(df).collect():
        kinds = [k for _, k, _, _ in PAIRS[r.pair_id][2]]
        assert (r.added_count, r.removed_count, r.modified_count) == tuple(kinds.count(k) for k in ("added", "removed", "modified"))
        assert r.identical == (not kinds)


def test_any_depth(spark):
    def nested(core):
        return '{"k":' * 40 + core + "}" * 40

    pairs = [(1, nested('{"x":1,"y":2}'), nested('{"x":1,"y":3,"z":4}')), (1, nested("[1]"), nested("[1.0]")), (2, '{"q":1}', '{"q":2}')]
    df = spark.createDataFrame(pairs, "pair_id int, a string, b string")
    path = ".".join(["k"] * 40)
    found = {(r.pair_id, r.path, r.diff_type, r.old_value, r.new_value) for r in diff.diff_payloads(df).collect()}
    assert found == {(1, f"{path}.y", "modified", "2", "3"), (1, f"{path}.z", "added", None, "4"), (2, "q", "modified", "1", "2")}
    counts = sorted((r.pair_id, r.added_count, r.removed_count, r.modified_count, r.identical) for r in diff.diff_summary(df).collect())
    assert counts == [(1, 0, 0, 0, True), (1, 1, 0, 1, False), (2, 0, 0, 1, False)]


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("[1e2]", "[100]", True),
        ("[true,[0.5]]", "[1,[5e-1]]", True),
        ('["1"]', "[1]", False),
        ('["a,1.0"]', '["a,1"]', False),
        ("9007199254740993", "9007199254740992.0", False),
        ("9007199254740992", "9007199254740992.0", True),
        ('[{"n":2.0}]', '[{"n":2}]', True),
    ],
)
def test_numbers_by_value(spark, a, b, same):
    df = spark.createDataFrame([(1, f'{{"v":{a}}}', f'{{"v":{b}}}')], "pair_id int, a string, b string")
    assert diff.diff_payloads(df).isEmpty() == same


def test_pair_records(records):
    left = records(("t", 0, 1, 1, b"k", b'{"a":1}', []))
    right = records(("u", 0, 9, 1, b"k", b'{"a":2}', []), ("u", 0, 10, 1, b"z", b"{}", []))
    rows = diff.diff_payloads(diff.pair_records(left, right, ["key"])).collect()
    assert [(r.path, r.old_value, r.new_value) for r in rows] == [("a", "1", "2")]


def test_lag(spark):
    ends = spark.createDataFrame(
        [("t", 0, 100), ("t", 1, 50), ("t", 2, 10), ("u", 0, 5)], "topic string, partition int, log_end_offset bigint"
    )
    committed = spark.createDataFrame(
        [("g", "t", 0, 40), ("g", "t", 1, 60), ("h", "u", 0, 5)],
        "group_id string, topic string, partition int, committed_offset bigint",
    )
    rows = {(r.group_id, r.topic, r.partition): (r.current_offset, r.lag) for r in lag.lag_by_partition(ends, committed).collect()}
    assert rows == {("g", "t", 0): (40, 60), ("g", "t", 1): (60, 0), ("g", "t", 2): (0, 10), ("h", "u", 0): (5, 0)}
    own = lag.lag_by_partition(ends.filter("topic = 't'"), committed, "new")
    assert {r.lag for r in own.collect()} == {100, 50, 10}
    none = lag.lag_by_partition(ends)
    assert {(r.group_id, r.lag) for r in none.collect()} == {("none", 0)}
    asked = spark.createDataFrame([("t",), ("gone",)], "topic string")
    totals = {(r.group_id, r.topic): (r.total_lag, r.partitions) for r in lag.lag_total(lag.lag_by_partition(ends, committed), asked).collect()}
    assert totals == {("g", "t"): (70, 3), ("h", "u"): (0, 1), ("unassigned", "gone"): (0, 0)}
    shares = {r.partition: round(r.lag_share, 4) for r in lag.lag_share(own).collect()}
    assert shares == {0: 0.625, 1: 0.3125, 2: 0.0625}
    shown = {r.partition: (r.severity, len(r.meter), r.page_severity, r.percent, r.bar_percent) for r in lag.lag_view(own).collect()}
    assert shown == {0: ("red", 10, "warn", 33, 33), 1: ("yellow", 5, "warn", 17, 17), 2: ("green", 1, "", 3, 5)}


def test_watermarks_and_counts(records):
    rows = records(("t", 0, 3, 1500, None, b"x", []), ("t", 0, 9, 1999, None, b"x", []), ("t.dlq", 1, 1, 2000, None, b"x", []))
    marks = {(r.topic, r.partition): (r.beginning_offset, r.log_end_offset) for r in lag.offsets(rows).collect()}
    assert marks == {("t", 0): (3, 10), ("t.dlq", 1): (1, 2)}
    assert {r.topic: (r.events, r.dlq_events) for r in stats.status_counts(rows).collect()} == {"t": (2, 0), "t.dlq": (1, 1)}
    assert {r.window_start_ms: r.events for r in stats.throughput(rows).collect()} == {1000: 2, 2000: 1}
