"""Ordered neighbours and running totals that do not put a whole group into one task.

One correlation id may own a third of the log, and a session is a single sequence. A window over such a group
would run in one task. Here a group is cut into time buckets: a window runs inside each bucket, one summary row per
bucket carries its last row and its size, and a window over these few summary rows links each bucket to the one
before. A bucket with too many rows is cut again, by time and then by offset, so records of one moment are spread too.
The result equals that of the plain window. Besides the rows themselves, the keys, times and coordinates are read once more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicwise.session import staged

BUCKET_MS = 60_000
BUCKET_OFFSETS = 1_000_000
#: Rows of a bucket that one task puts in order.
BUCKET_ROWS = 2_000_000
BUCKET = ("_bucket", "_at", "_sub_bucket")
ORDER = ("_ts", "offset", "topic", "partition")


def with_buckets(df: DataFrame, ts: str, bucket_ms: int) -> DataFrame:
    """Add ``_ts`` (missing time counts as 0) and the bucket columns, which sort like ``ORDER``.

    Rows without a time all share ``_ts`` 0; they are cut by offset instead.
    """
    df = df.withColumn("_ts", F.coalesce(ts, F.lit(0)).cast("bigint"))
    t = F.col("_ts")
    time_bucket = F.floor(t / bucket_ms).cast("bigint")
    return df.withColumns(
        {
            # Never NULL, and stated so: a join on them needs no NULL test that would be computed at the source.
            "_bucket": F.coalesce(F.when(t > 0, time_bucket + 1).when(t < 0, time_bucket), F.lit(0).cast("bigint")),
            "_at": F.lit(0).cast("bigint"),
            "_sub_bucket": F.coalesce(
                F.when(t == 0, F.floor(F.col("offset") / BUCKET_OFFSETS).cast("bigint")), F.lit(0).cast("bigint")
            ),
        }
    )


def follow(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    prev: str,
    step: str,
    bucket_ms: int | None = BUCKET_MS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add the previous row's ``ts`` as ``prev`` and the position in its group, from 1, as ``step``.

    Rows of a group are ordered by time (missing counts as 0), offset, topic, partition. ``bucket_ms=None`` uses one
    plain window per group, for data known to have no large group.
    """
    columns = df.columns
    if bucket_ms is None:
        w = Window.partitionBy(*keys).orderBy(*ORDER)
        numbered = df.withColumn("_ts", F.coalesce(ts, F.lit(0)).cast("bigint"))
        return numbered.withColumns(
            {prev: F.lag(ts).over(w), step: F.row_number().over(w).cast("bigint")}
        ).select(*columns, prev, step)

    by_bucket = [*keys, *BUCKET]
    narrow = with_buckets(df.select(*keys, ts, "offset", "topic", "partition"), ts, bucket_ms)
    summary = staged(_last_rows(narrow, by_bucket, ts), "buckets")
    large = summary.filter(F.col("_n") > bucket_rows).select(*[F.col(c).alias(f"_large_{c}") for c in by_bucket])
    bucketed = with_buckets(df, ts, bucket_ms)
    if not large.isEmpty():
        large = staged(large, "large-buckets")
        small = summary.join(large, [F.col(c).eqNullSafe(F.col(f"_large_{c}")) for c in by_bucket], "left_anti")
        bucketed = _cut(bucketed, large, by_bucket)
        summary = small.unionByName(_last_rows(_cut(narrow, large, by_bucket).filter("_is_large"), by_bucket, ts))

    w = Window.partitionBy(*by_bucket).orderBy(*ORDER)
    inside = bucketed.withColumns({"_prev_inside": F.lag(ts).over(w), "_nth": F.row_number().over(w)})
    ordered = Window.partitionBy(*keys).orderBy(*BUCKET)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    links = summary.select(
        *by_bucket,
        F.lag("_last").over(ordered).alias("_last_before"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
    )
    joined = inside.join(links, by_bucket)
    return joined.select(
        *[joined[c] for c in columns],
        F.when(F.col("_nth") == 1, F.col("_last_before")).otherwise(F.col("_prev_inside")).alias(prev),
        (F.col("_n_before") + F.col("_nth")).cast("bigint").alias(step),
    )


def _last_rows(narrow: DataFrame, by_bucket: Sequence[str], ts: str) -> DataFrame:
    """One row per bucket: ``_n`` rows, and ``_last``, the time of the last of them (NULL if it has none).

    In a bucket of times the last one is the largest, so rows collapse in hash aggregation before they are shuffled. Missing
    times and zeros stand in one bucket; there the full order tells which is last.
    """
    counts = narrow.groupBy(*by_bucket).agg(F.max("_ts").alias("_newest"), F.count(F.lit(1)).alias("_n"))
    place = F.struct("offset", "topic", "partition")
    untimed = narrow.filter(F.col("_ts") == 0).groupBy(*by_bucket).agg(F.max_by(F.struct(F.col(ts).alias("t")), place).alias("_end"))
    untimed = untimed.select(*[F.col(c).alias(f"_u_{c}") for c in by_bucket], "_end")
    found = counts.join(untimed, [F.col(c).eqNullSafe(F.col(f"_u_{c}")) for c in by_bucket], "left")
    last = F.when((F.col("_newest") != 0) | F.col("_end").isNull(), F.col("_newest")).otherwise(F.col("_end.t"))
    return found.select(*by_bucket, last.alias("_last"), "_n")


def _cut(rows: DataFrame, large: DataFrame, by_bucket: Sequence[str]) -> DataFrame:
    """``rows`` with the buckets in ``large`` cut by time and offset, and ``_is_large``.

    ``large`` has at most one row per ``BUCKET_ROWS`` rows; Spark broadcasts it by its measured size.
    """
    same = [F.col(c).eqNullSafe(F.col(f"_large_{c}")) for c in by_bucket]
    marked = rows.join(large, same, "left").withColumn("_is_large", F.col("_large__bucket").isNotNull())
    cut = F.floor(F.col("offset") / BUCKET_OFFSETS).cast("bigint")
    finer = {"_at": F.when(F.col("_is_large"), F.col("_ts")).otherwise(F.col("_at")), "_sub_bucket": F.when(F.col("_is_large"), cut).otherwise(F.col("_sub_bucket"))}
    return marked.withColumns(finer).drop(*[f"_large_{c}" for c in by_bucket])


def running_delay(df: DataFrame, ts: str, delay: Callable[[Column, Column], Column], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Delay to the previous row and its running total over the whole frame, as ``delay_s`` and ``at_s``, and the row's place in
    it, from 1 without gaps, as ``sequence``.

    ``delay`` maps the ``(previous, current)`` time columns to seconds. Totals are summed in whole microseconds,
    so they do not depend on the order of additions.
    """
    columns = df.columns
    w = Window.partitionBy(*BUCKET).orderBy(*ORDER)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = with_buckets(df, ts, bucket_ms)
    rows = rows.withColumns(
        {"_prev": F.lag(ts).over(w), "_nth": F.row_number().over(w), "_next": F.lead(F.lit(1)).over(w)}
    )
    rows = rows.withColumn("_delay", F.when(F.col("_nth") > 1, delay(F.col("_prev"), F.col(ts))).otherwise(0.0))
    rows = rows.withColumns({"_sum": F.sum(_micros(F.col("_delay"))).over(so_far), "_first": F.first(ts).over(so_far)})

    ends = rows.filter(F.col("_next").isNull()).select(*BUCKET, "_first", F.col(ts).alias("_last"), "_sum", F.col("_nth").alias("_n"))
    ordered = Window.orderBy(*BUCKET)
    entry = ends.withColumns(
        {"_entry": F.when(F.row_number().over(ordered) > 1, delay(F.lag("_last").over(ordered), F.col("_first"))).otherwise(0.0)}
    )
    through = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    links = entry.select(
        *BUCKET,
        "_entry",
        (F.sum(F.col("_sum") + _micros(F.col("_entry"))).over(through) - F.col("_sum")).alias("_base"),
        (F.sum("_n").over(through) - F.col("_n")).alias("_n_before"),
    )
    joined = rows.join(links, list(BUCKET))
    return joined.select(
        *[joined[c] for c in columns],
        F.when(F.col("_nth") == 1, F.col("_entry")).otherwise(F.col("_delay")).alias("delay_s"),
        ((F.col("_base") + rows["_sum"]) / F.lit(1_000_000.0)).alias("at_s"),
        (F.col("_n_before") + F.col("_nth")).cast("bigint").alias("sequence"),
    )


def _micros(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("bigint")
