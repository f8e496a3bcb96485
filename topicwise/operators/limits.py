"""Limits in a defined order: tail of each partition, first and latest records, position cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCAN_ORDER = ("topic", "partition", "offset")
# Largest limit kept in one heap per task. Beyond it offsets are counted in blocks instead.
HEAP_LIMIT = 100_000
BLOCK = 100_000
# Spark's own limit for keeping the first rows of each window group before the shuffle.
GROUP_LIMIT = 1_000


def tail_n(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` records of every partition by offset. Counts rows, so gaps in a compacted log do not matter.

    Apply it to RAW records and decode what is left. A partition may hold most of the log: for a small ``n`` Spark keeps
    ``n`` rows per partition in each task before it shuffles; a larger one goes through block counts.
    """
    if n > GROUP_LIMIT:
        return _long_tail(df, n)
    newest = Window.partitionBy("topic", "partition").orderBy(F.col("offset").desc())
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def _long_tail(df: DataFrame, n: int) -> DataFrame:
    """Rows are counted per block of offsets, which collapses before the shuffle. Blocks wholly inside the last ``n``
    are kept as they are; only the block in which the n-th last row lies is ranked.
    """
    keys = ["topic", "partition"]
    blocks = df.groupBy(*keys, _block().alias("_block")).agg(F.count(F.lit(1)).alias("_rows"))
    later = Window.partitionBy(*keys).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = blocks.select(
        *keys, "_block", (F.lit(n) - F.coalesce(F.sum("_rows").over(later), F.lit(0))).alias("_room"), "_rows"
    ).filter("_room > 0")
    near = df.withColumn("_block", _block()).join(kept, [*keys, "_block"])
    # A block that fits needs no rank; its rows form groups of their own.
    group = F.when(F.col("_rows") > F.col("_room"), F.lit(-1)).otherwise(F.col("offset"))
    newest = Window.partitionBy(*keys, "_block", group).orderBy(F.col("offset").desc())
    ranked = near.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") <= F.col("_room")).select(*df.columns)


def _block() -> Column:
    return F.floor(F.col("offset") / BLOCK).cast("bigint")


def first_in_scan(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records by topic, partition, offset (a top-k, not a full sort)."""
    return df.orderBy(*SCAN_ORDER).limit(n)


def stop_after(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records by topic, partition, offset, however large ``n`` is: no task holds them all.

    Only the place of the n-th record is searched (see :func:`nth_position`); everything before it stays where it is. Of
    several records stored at that place as many stay as still fit, by value. Filter before to count matches, after to count
    what was scanned. Fewer than ``n`` records stay whole, and so does nothing for ``n`` below 1.
    """
    if n < 1:
        return df.limit(0)
    cutoff = nth_position(df, n).scalar()
    before = df.filter(position() < cutoff)
    # A repeated place is rare, so this window ranks few rows.
    rank = F.row_number().over(Window.partitionBy(*SCAN_ORDER).orderBy("value"))
    last = df.filter(position() == cutoff).withColumn("_rank", rank)
    last = last.filter(F.col("_rank") <= n - before.agg(F.count(F.lit(1))).scalar())
    return before.unionByName(last.drop("_rank"))


def recent(df: DataFrame, n: int = 300, dlq_only: bool = False) -> DataFrame:
    """The ``n`` most recent records (a top-k, not a full sort)."""
    if dlq_only:
        df = df.filter("is_dlq")
    newest = [F.col("timestamp_ms").desc(), F.col("offset").desc(), F.col("topic").desc(), F.col("partition").desc()]
    return df.orderBy(*newest).limit(n)


def position(*names: str) -> Column:
    return F.struct(*(names or SCAN_ORDER))


def nth_position(df: DataFrame, n: int) -> DataFrame:
    """One row, ``cutoff``: the scan position of the n-th record, or of the last one if there are fewer.

    Small limits use a top-k. A large one is found by counting blocks of offsets first: only the block that holds the
    n-th record is sorted.
    """
    places = df.select(*SCAN_ORDER)
    if n <= HEAP_LIMIT:
        return places.orderBy(*SCAN_ORDER).limit(n).agg(F.max(position()).alias("cutoff"))
    counts = places.groupBy("topic", "partition", _block().alias("_block")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per block of offsets, so this window without a partition stays small.
    through = Window.orderBy("topic", "partition", "_block").rowsBetween(Window.unboundedPreceding, -1)
    started = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(through), F.lit(0))).filter(F.col("_before") < n)
    edge = started.agg(
        F.max_by(F.struct("topic", "partition", "_block", "_before"), F.struct("topic", "partition", "_block")).alias("edge")
    ).select("edge.*")
    inside = places.withColumn("_block", _block()).join(
        edge, ["topic", "partition", "_block"]
    )
    ranked = inside.withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy("topic", "partition", "_block").orderBy("offset"))
    )
    return ranked.filter(F.col("_rank") <= n).agg(F.max(position()).alias("cutoff"))
