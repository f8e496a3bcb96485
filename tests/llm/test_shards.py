from collections import Counter

from topicwise.llm import shards
from topicwise.llm.queries import sharded

from .helpers import frame, texts


def test_every_row_once(spark, tmp_path):
    rows = texts() + [(1000, "hot")] * 50 + [(2000 + i, f"text {i}") for i in range(100)]
    docs = frame(spark, rows).repartition(3).cache()
    path = shards.write_shards(docs, str(tmp_path / "s"), shards=8, bucket_bytes=4096)
    out = shards.read_shards(spark, path, docs.schema).select("shard", "slot", "record.doc_id", "record.text", "record.part").collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    assert {r["part"] for r in out} == {"x"}
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(sizes) == list(range(8))
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))


def test_order_is_mixed(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    out = shards.read_shards(spark, shards.write_shards(docs, str(tmp_path / "s"), shards=4), docs.schema).selectExpr("shard", "slot", "record.doc_id AS i").collect()
    order = [r["i"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    fixed = sum(a + 1 == b for a, b in zip(order, order[1:]))
    assert fixed < 15  # one is expected
    means = [sum(r["i"] for r in out if r["shard"] == s) / 1000 for s in range(4)]
    assert all(abs(m - 2000) < 200 for m in means)


def test_nothing(spark, tmp_path):
    docs = frame(spark, [])
    path = shards.write_shards(docs, str(tmp_path / "s"))
    assert not list((tmp_path / "s").glob("shard=*"))
    assert shards.read_shards(spark, path, docs.schema).collect() == []
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    out = sharded(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.collect() == []


def test_records_are_shuffled_once(spark):
    """Whatever the size of the tables or the order in which stages end: the offsets go to the records."""
    docs = spark.range(100).selectExpr("id AS doc_id", "'t' AS text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shards._placed(docs, 8, 17, "text", 4096)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
