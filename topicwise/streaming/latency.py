"""Hop latency on a live stream: each micro-batch is linked like a table, and one remembered row per trace links the batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicwise.operators.sequence import BUCKET_MS, follow
from topicwise.session import staged
from topicwise.streaming.tables import MergedTable, exists

HOPS = (
    "correlation_id string, step bigint, topic string, partition int, offset bigint, timestamp_ms bigint, "
    "status string, latency_ms double"
)
COLUMNS = ["correlation_id", "step", "topic", "partition", "offset", "timestamp_ms", "status", "latency_ms"]
TRACES = "correlation_id string, last struct<batch:bigint,timestamp_ms:bigint,step:bigint,seen_ms:bigint>"
DAY_MS = 86_400_000
#: Remembered traces of one batch that are sent whole to every task: an id and three numbers each.
BROADCAST_TRACES = 200_000
#: Parts that the rows of a trace are dealt to where its remembered row comes by a shuffle.
SALTS = 32


def keep_hops(
    records: DataFrame,
    correlation_id: Column,
    path: str,
    checkpoint: str,
    ttl_ms: int = DAY_MS,
    available_now: bool = True,
    bucket_ms: int | None = BUCKET_MS,
    every: int = 50,
) -> StreamingQuery:
    """Write hops with latency as they arrive; :func:`read_hops` reads them.

    Within a micro-batch hops are put in time order by time buckets, so a trace that is the whole batch is spread over the
    cluster and no task holds it in memory. A hop that comes after a later one has latency 0. Traces quiet for ``ttl_ms`` (of
    processing time) are forgotten and begin again at step 1. Records without an id are in no trace. A repeated batch overwrites
    its own hops.
    """
    traces = _traces(path, ttl_ms, every)

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Linking reads the hops several times: they are decoded once. The next batch takes the folder over.
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/arrived")
        batch = spark.read.schema(batch.schema).parquet(f"{path}/arrived")
        linked = follow(batch, ["correlation_id"], "timestamp_ms", "_prev", "_nth", bucket_ms)
        ids = batch.select(F.col("correlation_id").alias("_id")).distinct()
        known = traces.rows(spark, number).join(ids, F.col("correlation_id") == F.col("_id"), "left_semi")
        known = staged(known.select(F.col("correlation_id").alias("_trace"), "last"), "known-traces")
        joined = _with_known(linked, known)
        before = F.when(F.col("_nth") == 1, F.col("last.timestamp_ms")).otherwise(F.col("_prev"))
        joined = joined.withColumn("_gap", F.col("timestamp_ms") - before)
        latency = F.when(F.col("_gap").isNotNull(), F.greatest(F.lit(0), F.col("_gap"))).cast("double")
        step = F.col("_nth") + F.coalesce("last.step", F.lit(0))
        hops = joined.withColumns({"step": step.cast("bigint"), "latency_ms": latency}).select(*COLUMNS)
        folder = f"{path}/hops/batch-{number:09d}"
        hops.write.mode("overwrite").parquet(folder)

        written = spark.read.schema(HOPS).parquet(folder).groupBy("correlation_id")
        ends = written.agg(F.max_by("timestamp_ms", "step").alias("timestamp_ms"), F.max("step").alias("step"))
        last = F.struct(F.lit(number).cast("bigint").alias("batch"), "timestamp_ms", "step", _now_ms().alias("seen_ms"))
        traces.add(ends.select("correlation_id", last.alias("last")), number)

    status = F.when(F.col("is_dlq"), "DLQ_POISON").otherwise("OK").alias("status")
    hops = records.select(correlation_id.alias("correlation_id"), "topic", "partition", "offset", "timestamp_ms", status)
    writer = hops.filter("correlation_id <> ''").writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_hops(spark: SparkSession, path: str) -> DataFrame:
    """All hops that :func:`keep_hops` wrote; none if no batch has come yet."""
    if not exists(spark, f"{path}/hops"):
        return spark.createDataFrame([], HOPS)
    return spark.read.schema(HOPS).option("recursiveFileLookup", "true").parquet(f"{path}/hops")


def _traces(path: str, ttl_ms: int, every: int) -> MergedTable:
    """The last hop of each trace that was seen within ``ttl_ms``."""
    return MergedTable(
        f"{path}/traces", TRACES, ["correlation_id"], {"last": F.max}, every, lambda: F.col("last.seen_ms") >= _now_ms() - ttl_ms
    )


def _with_known(linked: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with the remembered row of their trace as ``last``, NULL without one."""
    if known.count() <= BROADCAST_TRACES:
        return linked.join(F.broadcast(known), F.col("correlation_id") == F.col("_trace"), "left")
    dealt = known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = linked.withColumn("_salt", F.pmod(F.col("_nth"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, (F.col("correlation_id") == F.col("_trace")) & (F.col("_salt") == F.col("_part")), "left")


def _now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())
