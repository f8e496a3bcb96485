"""Many substrings at once, and links over bucket borders, against plain versions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from topicwise.operators import matching, sequence, trace


def test_pairs_like_contains(spark, records, monkeypatch):
    rng = random.Random(7)
    keys = ["".join(rng.choice("abé-") for _ in range(rng.randrange(1, 40))) for _ in range(40)] + ["x" * 10_000 + "needle", "ÄÖ日本", ""]
    ids = {"".join(rng.choice("ABé-") for _ in range(rng.randrange(1, 9))) for _ in range(60)}
    ids |= {k[a : a + n] for k in keys for a, n in [(rng.randrange(30), rng.randrange(1, 30))]} | {"needle", "x" * 9_000, "日", "absent-id-of-some-length"}
    rows = records(*[("t", 0, i, i, k.encode(), b'{"order_id":"%d"}' % i, [("x-trace-id", k[::-1].encode())]) for i, k in enumerate(keys)])
    table = spark.createDataFrame([(i,) for i in sorted(ids)] + [(None,), ("",)], "correlation_id string")
    expected = sorted((i, n) for i in ids - {""} for n, k in enumerate(keys) if any(i.lower() in t.lower() for t in (k, k[::-1], str(n))))
    found = lambda: sorted((r.correlation_id, r.offset) for r in trace.pair_with_ids(rows, table).select("correlation_id", "offset").collect())
    assert found() == expected
    monkeypatch.setattr(trace, "BROADCAST_IDS", 0)
    assert found() == expected
    assert trace.pair_with_ids(rows, table.limit(0)).count() == 0


def test_few_windows_pass_with_many_ids(spark, records, monkeypatch):
    monkeypatch.setattr(matching, "MOST_SLOTS", matching.FEWEST_SLOTS)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh0123") for _ in range(n))
    keys, ids = [word(40) for _ in range(100)], {word(8) for _ in range(6000)}
    ids |= {k[5:13] for k in keys}
    anchored = spark.createDataFrame([(8, i.encode()) for i in sorted(ids)], "width int, window binary")
    rows = spark.createDataFrame([(k.encode(),) for k in keys], "data binary")
    found = {(bytes(r["data"]).decode(), r["_at"]) for r in matching.likely_windows(rows, "data", anchored, len(ids)).collect()}
    assert found >= {(k, i + 1) for k in keys for i in range(33) if k[i : i + 8] in ids}
    assert len(found) < 0.1 * 33 * len(keys) + 100
    monkeypatch.setattr(trace, "BROADCAST_IDS", 0)
    table = spark.createDataFrame([(i,) for i in sorted(ids)], "correlation_id string")
    logged = records(*[("t", 0, i // 2, i, k.encode(), b"{}", [("x-trace-id", k.encode())]) for i, k in enumerate(keys)])
    pairs = sorted((r.correlation_id, r.offset) for r in trace.pair_with_ids(logged, table).select("correlation_id", "offset").collect())
    assert pairs == sorted((i, n // 2) for i in ids for n, k in enumerate(keys) if i in k)


def test_plan_does_not_grow_with_lengths(spark, records):
    rows = records(("t", 0, 1, 1, b"k", b"{}", []))
    sizes = []
    for lengths in ([16], range(16, 116)):
        ids = spark.createDataFrame([("a" * n,) for n in lengths], "correlation_id string")
        sizes.append(len(trace.pair_with_ids(rows, ids).select("offset")._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 1.2 * sizes[0]


def test_rarest_window(spark):
    ids = spark.createDataFrame([("ord_1",), ("ord_2",), ("ord_12345678",), ("z",)], "t string")
    found = {r.t: bytes(r.window).decode() for r in matching.anchors(ids, "t").collect()}
    assert found["ord_1"] == "rd_1" and found["ord_2"] == "rd_2" and found["z"] == "z" and len(found["ord_12345678"]) == 8


@pytest.mark.parametrize("bucket_rows", [1, 3, 10**6])
def test_links_like_a_plain_window(spark, bucket_rows, monkeypatch):
    """Equal offsets in two topics, missing times, many records of one moment, and buckets cut again."""
    monkeypatch.setattr(sequence, "BUCKET_OFFSETS", 4)
    rng = random.Random(bucket_rows)
    rows = [("a", "a", 0, 5, None), ("a", "b", 0, 5, 0), ("a", "a", 0, 9, 70_000), ("b", "a", 0, 5, 0), ("b", "b", 0, 5, None), ("b", "b", 1, 6, -5)]
    rows += [(rng.choice("cd"), rng.choice("xy"), rng.randrange(2), rng.randrange(20), rng.choice((None, 0, 1, 60_000, 60_000, 60_001, 500_000))) for _ in range(120)]
    df = spark.createDataFrame(sorted(set(rows), key=repr), "k string, topic string, partition int, offset bigint, ms bigint").repartition(3)
    order = Window.partitionBy("k").orderBy(F.coalesce("ms", F.lit(0)), "offset", "topic", "partition")
    plain = df.withColumns({"prev": F.lag("ms").over(order), "step": F.row_number().over(order).cast("bigint")})
    found = sequence.follow(df, ["k"], "ms", "prev", "step", 1000, bucket_rows=bucket_rows)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    alone = sequence.follow(df.filter("k = 'c'"), [], "ms", "prev", "step", 1000, bucket_rows=bucket_rows)
    assert sorted(map(tuple, alone.collect()), key=repr) == sorted((tuple(r) for r in plain.filter("k = 'c'").collect()), key=repr)
