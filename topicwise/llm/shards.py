"""Random sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records into buckets by a seeded hash, each small enough for one task's memory. Pass two shuffles each
bucket with Fisher-Yates (the built-in ``shuffle`` on an array) and writes it. Buckets laid end to end are one uniform
random order of all rows; shards are equal cuts of that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from topicwise.session import scratch_dir


def write_shards(
    docs: DataFrame,
    path: str | None = None,
    *,
    shards: int = 8,
    seed: int = 17,
    text_col: str = "text",
    bucket_bytes: int = 64 << 20,
) -> str:
    """Write every row of ``docs`` once, as (shard, slot, record), and return the folder.

    ``record`` is the whole input row, so input columns may have any name. ``slot`` counts from 0 without gaps in each
    shard, and shard sizes differ by one row at most. The hash takes the seed and the row's place in the input,
    so equal rows and repeated or null ids scatter like any others. Rows must come in a fixed order (a table scan); write
    other inputs first. A task holds one bucket, of about ``bucket_bytes`` of text and at most about 100,000 rows. Null texts
    and empty texts are ordinary rows; an empty table gives an empty folder.
    """
    path = path or scratch_dir(docs.sparkSession, "shards")
    _placed(docs, shards, seed, text_col, bucket_bytes).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def _placed(docs: DataFrame, shards: int, seed: int, text_col: str, bucket_bytes: int) -> DataFrame:
    """(shard, slot, record) of every row. Only the scatter to buckets shuffles records."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("record"), F.monotonically_increasing_id().alias("place"), size.alias("bytes"))
    total = rows.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).first()
    buckets = max(4 * shards, -(-(total["bytes"] or 0) // bucket_bytes), total["rows"] // 100_000)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(buckets)).cast("int")
    rows = rows.select("record", "place", bucket.alias("bucket"))

    # Offsets of the buckets in the global order: one narrow pass, one small row per bucket.
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = counts.select(F.col("bucket").alias("b"), F.expr("sum(n) OVER (ORDER BY bucket) - n").alias("base"))
    # collect_list keeps arrival order; sorting by place makes a repeated task give the same bucket.
    whole = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("place", "record"))).alias("rows"))
    mixed = whole.select("bucket", F.expr(f"shuffle(transform(rows, r -> r.record), {seed})").alias("rows"))
    mixed = mixed.select("bucket", F.posexplode("rows").alias("rank", "record"))
    position = F.col("base") + F.col("rank")
    # One row per bucket: without the hint the records may be shuffled a second time before its size is known.
    placed = (
        mixed.join(F.broadcast(offsets), mixed["bucket"] == offsets["b"])
        .select("record", position.alias("position"))
        .withColumn("shard", F.expr(f"position * {shards} DIV {max(total['rows'], 1)}").cast("int"))
        .withColumn("slot", F.expr(f"position - (shard * {total['rows']}L + {shards - 1}) DIV {shards}"))
    )
    return placed.select("shard", "slot", "record")


def read_shards(spark: SparkSession, path: str, record: StructType) -> DataFrame:
    """(slot, record, shard) of a folder of shards; ``record`` is the schema of what was written, as an empty folder has none."""
    schema = StructType().add("slot", LongType()).add("record", record).add("shard", IntegerType())
    return spark.read.schema(schema).parquet(path)
