"""Streaming forms of the record operators. Every function takes RECORD rows from ``to_records`` on a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from topicwise.operators.filters import filter_events
from topicwise.operators.lag import lag_by_partition, offsets
from topicwise.operators.limits import recent
from topicwise.operators.stats import throughput
from topicwise.operators.trace import TRACE_TOPICS, summary_of_topics, trace_topics
from topicwise.operators.views import table_view
from topicwise.sinks.session import write_session
from topicwise.streaming.tables import MergedTable


def tail(records: DataFrame, predicate: Column | str | None = None, regex: str | None = None) -> DataFrame:
    """Filtered table view of a stream. Stateless: one stage, no shuffle."""
    return table_view(filter_events(records, predicate, regex))


def dlq_alerts(records: DataFrame) -> DataFrame:
    """A message for each arriving dead letter. Stateless."""
    place = F.format_string("[P:%d Offset:%d]", "partition", "offset")
    return records.filter("is_dlq").select(
        "topic", "partition", "offset", F.concat(F.lit("Poison Pill detected on "), "topic", F.lit(" "), place, F.lit("!")).alias("alert")
    )


def keep_throughput(
    records: DataFrame, path: str, checkpoint: str, width: str = "1 second", available_now: bool = True, every: int = 50
) -> StreamingQuery:
    """Count records per window of event time; :func:`read_throughput` reads the counters.

    A micro-batch adds its own counts. So a late record, however late, changes its window's row, and no state grows with
    the windows seen.
    """
    return _keep(records, _counters(path, every), checkpoint, available_now, lambda batch: throughput(batch, width))


def read_throughput(spark: SparkSession, path: str) -> DataFrame:
    return _counters(path).rows(spark)


def _counters(path: str, every: int = 50) -> MergedTable:
    schema = "window_start_ms bigint, events bigint, dlq_events bigint"
    return MergedTable(path, schema, ["window_start_ms"], {"events": F.sum, "dlq_events": F.sum}, every)


def keep_trace_summary(
    records: DataFrame, correlation_id: Column, path: str, checkpoint: str, available_now: bool = True, every: int = 50
) -> StreamingQuery:
    """Keep hop count, first and last time, topics and dead-letter flag of every trace; :func:`read_trace_summary` reads them.

    A micro-batch adds one row per trace and topic, so late hops update their trace, and a trace of any size stays spread.
    """
    traced = records.withColumn("correlation_id", correlation_id).filter("correlation_id <> ''")
    return _keep(traced, _trace_topics(path, every), checkpoint, available_now, trace_topics)


def read_trace_summary(spark: SparkSession, path: str) -> DataFrame:
    """What ``trace_summary`` gives for all records so far."""
    return summary_of_topics(_trace_topics(path).rows(spark))


def _trace_topics(path: str, every: int = 50) -> MergedTable:
    merge = {"n": F.sum, "first_ts": F.min, "last_ts": F.max, "first_seen": F.min, "has_dlq": F.bool_or}
    return MergedTable(path, TRACE_TOPICS, ["correlation_id", "topic"], merge, every)


def _keep(
    records: DataFrame, table: MergedTable, checkpoint: str, available_now: bool, partial: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Add ``partial`` of each micro-batch to a table."""
    writer = records.writeStream.foreachBatch(lambda batch, number: table.add(partial(batch), number))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last written row of every key."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "_batch"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
    return newest.select(*keys, *[F.col("v")[c].alias(c) for c in values])


def keep_recent(records: DataFrame, path: str, checkpoint: str, n: int = 300, dlq_only: bool = False) -> StreamingQuery:
    """Maintain a table of the ``n`` most recent records; read it with :func:`read_recent`.

    Two folders take turns: a batch reads the one of the batch before and overwrites the other, so repeating a batch
    after a failure gives the same table, and old versions do not pile up.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        top = recent(batch, n, dlq_only).drop("payload")
        if number > 0:
            known = spark.read.parquet(f"{path}/turn-{(number - 1) % 2}").drop("_batch")
            top = recent(top.unionByName(known), n)
        top.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/turn-{number % 2}")

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_recent(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    newest = rows.select(F.max("_batch")).scalar()
    return rows.filter(F.col("_batch") == newest).drop("_batch")


def record_stream(
    records: DataFrame,
    path: str,
    checkpoint: str,
    max_messages: int | None = None,
    duration_seconds: float | None = None,
    available_now: bool = False,
) -> int:
    """Capture a stream as a session until it ends, ``duration_seconds`` pass or ``max_messages`` are written.

    Each micro-batch has its own folder and overwrites it when repeated. What an earlier run wrote to ``path`` counts, so a
    restart goes on to the same limit. Returns the number of records in the session.
    """
    written = _written(records.sparkSession, path)

    def capture(batch: DataFrame, number: int) -> None:
        before = sum(n for b, n in written.items() if b != number)
        if max_messages is not None:
            if before >= max_messages:
                return
        left = None if max_messages is None else max_messages - before
        written[number] = write_session(batch, f"{path}/batch-{number:09d}", left)

    writer = records.writeStream.foreachBatch(capture).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    waited = 0.0
    while query.isActive and (duration_seconds is None or waited < duration_seconds):
        if max_messages is not None and sum(written.values()) >= max_messages:
            break
        query.awaitTermination(0.5)
        waited += 0.5
    query.stop()
    failure = query.exception()
    if failure is not None:
        raise failure
    return sum(written.values())


def _written(spark: SparkSession, path: str) -> dict[int, int]:
    """Records per batch folder of a session; one row per batch."""
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    batch = F.regexp_extract(F.input_file_name(), "/batch-([0-9]+)/[^/]*$", 1)
    return {int(r["batch"]): r["n"] for r in lines.groupBy(batch.alias("batch")).agg(F.count("*").alias("n")).collect() if r["batch"]}


def progress_lag(progress: Mapping, group: str | None = None) -> list[dict]:
    """Lag of each partition a Kafka stream reads, from the JSON of its progress: nothing is read from the log.

    The stream's own end offsets are what its group has consumed, the latest offsets the ends of the log. A source without
    latest offsets (not Kafka, or none known yet) gives no rows; a partition the stream has not begun counts from its start
    offset, or from 0.
    """
    rows = []
    for source in progress.get("sources") or []:
        ends, done, begun = (_offsets_of(source.get(k)) for k in ("latestOffset", "endOffset", "startOffset"))
        for place in sorted(ends):
            current = done.get(place, begun.get(place, 0))
            rows.append({
                "group_id": group or "none", "topic": place[0], "partition": place[1], "log_end_offset": ends[place],
                "current_offset": current, "lag": max(0, ends[place] - current),
            })
    return rows


def _offsets_of(text: str | Mapping | None) -> dict[tuple[str, int], int]:
    """Offsets by (topic, partition) of a source's offset JSON; none if it has another form."""
    found = json.loads(text) if isinstance(text, str) and text.lstrip().startswith("{") else text
    if not isinstance(found, Mapping) or not all(isinstance(parts, Mapping) for parts in found.values()):
        return {}
    return {(topic, int(p)): int(o) for topic, parts in found.items() for p, o in parts.items()}


class LagListener(StreamingQueryListener):
    """Calls ``write(rows, batch number)`` with :func:`progress_lag` after each micro-batch that has any."""

    def __init__(self, write: Callable[[list[dict], int], None], group: str | None = None) -> None:
        self.write, self.group = write, group

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        if rows := progress_lag(progress, self.group):
            self.write(rows, progress["batchId"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def refresh_lag(
    records: DataFrame,
    committed: Callable[[SparkSession], DataFrame],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    group: str | None = None,
    every: str | None = "4 seconds",
) -> StreamingQuery:
    """Recompute lag with every micro-batch. End offsets are kept as state, one row per partition.

    ``committed`` reads the committed offsets anew each time; ``write`` takes the lag rows and the batch number.
    ``every=None`` handles what is there and stops.
    """

    def refresh(ends: DataFrame, number: int) -> None:
        write(lag_by_partition(ends, committed(ends.sparkSession), group), number)

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    writer = offsets(records).writeStream.outputMode("complete").foreachBatch(refresh)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def append_to(frame: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stateless or watermarked stream to Parquet, exactly once."""
    writer = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
