"""Keyed tables that micro-batches add to: partial results per batch, merged when read, compacted now and then.

Spark keeps no state for them and needs no watermark: a late record changes its row like any other. What a batch adds must be
mergeable (sums, minima, maxima, latest values).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MergedTable:
    """A table of one row per key under ``path``; ``merge`` maps each value column to the aggregate that joins two of its values.

    Batch N writes ``batch-N`` and overwrites it when it is repeated. Every ``every`` batches the finished ones before it become
    one ``snapshot-M`` of all up to M; what the snapshot before that one had replaced is deleted then, so readers of that moment
    still find their files. There are at most ``2 * every + 3`` folders. ``keep`` is a condition on merged rows: others are not
    returned, and are gone with the next snapshot.
    """

    def __init__(
        self,
        path: str,
        schema: str,
        keys: list[str],
        merge: Mapping[str, Callable[[str], Column]],
        every: int = 50,
        keep: Callable[[], Column] | None = None,
    ) -> None:
        self.path, self.schema, self.keys, self.merge, self.every, self.keep = path, schema, keys, merge, every, keep

    def add(self, rows: DataFrame, number: int) -> None:
        """Add the rows of one micro-batch. Numbers must not go back: a lost checkpoint would count records twice."""
        spark = rows.sparkSession
        snapshots, batches = self._finished(spark)
        newest = max([*snapshots, *batches], default=-1)
        if newest > number or number in snapshots:
            raise ValueError(f"{self.path} already has batch {newest}: batch {number} belongs to another checkpoint")
        self._compact(spark, number, snapshots, batches)
        self._merged(rows).write.mode("overwrite").parquet(f"{self.path}/batch-{number:09d}")

    def rows(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The merged rows of all batches, or of those ``before`` a number; none if there is no batch yet."""
        snapshots, batches = self._finished(spark)
        current = self._current(snapshots, batches, before)
        stored = spark.read.schema(self.schema).parquet(*current) if current else spark.createDataFrame([], self.schema)
        merged = self._merged(stored)
        return merged.filter(self.keep()) if self.keep else merged

    def _current(self, snapshots: list[int], batches: list[int], before: int | None) -> list[str]:
        """Folders that together hold every batch (before ``before``) once."""
        base = max((s for s in snapshots if before is None or s < before), default=-1)
        parts = [f"{self.path}/batch-{b:09d}" for b in batches if b > base and (before is None or b < before)]
        return [f"{self.path}/snapshot-{base:09d}"] * (base >= 0) + parts

    def _compact(self, spark: SparkSession, number: int, snapshots: list[int], batches: list[int]) -> None:
        base = max(snapshots, default=-1)
        waiting = [b for b in batches if base < b < number]
        if len(waiting) < self.every:
            return
        self.rows(spark, number).write.mode("overwrite").parquet(f"{self.path}/snapshot-{max(waiting):09d}")
        files, place = _files(spark, self.path)
        for kind, numbers, last in (("snapshot", snapshots, base - 1), ("batch", batches, base)):
            for n in numbers:
                if n <= last:
                    files.delete(spark._jvm.org.apache.hadoop.fs.Path(place, f"{kind}-{n:09d}"), True)

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[how(name).alias(name) for name, how in self.merge.items()])

    def _finished(self, spark: SparkSession) -> tuple[list[int], list[int]]:
        """Numbers of the snapshots and of the batches that were written to their end."""
        files, place = _files(spark, self.path)
        found: dict[str, list[int]] = {"snapshot": [], "batch": []}
        for status in files.listStatus(place) if files.exists(place) else []:
            kind, _, number = status.getPath().getName().partition("-")
            if kind in found and number.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
        return sorted(found["snapshot"]), sorted(found["batch"])


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place
