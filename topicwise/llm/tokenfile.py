"""Token ids as ORC files: run-length encoded integers in stripes, row indexes, a Bloom filter on the document id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwise.llm.tokens import encoded
from topicwise.session import scratch_dir


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    *,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = 64 << 20,
) -> str:
    """Write each document's ids in ascending document order and return the folder.

    Files follow each other by ``part``; a row has doc_id, part, start (ids before it in its part), n_tokens, ids. Rows are
    range-partitioned by id and, among equal or null ids, by their place in the input, so one id with many rows takes many
    parts; null ids come first. Null and empty texts are the end id alone. An empty table gives a folder without rows.
    Readers skip stripes and row groups by the id's statistics and Bloom filter: ``spark.read.orc(path).filter("doc_id = 7")``.
    """
    path = path or scratch_dir(docs.sparkSession, "token-files")
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch, ids in encoded(batches, tokenizer, "text", end_id):
            n = np.array([len(x) // 4 for x in ids], "int32")
            ends = np.cumsum(n, dtype="int64")
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(np.frombuffer(b"".join(ids), "<i4"))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), part, "int32")), pa.array(start + ends - n), pa.array(n), lists],
                ["doc_id", "part", "start", "n_tokens", "ids"],
            )
            start += int(ends[-1])

    files = rows.mapInArrow(run, f"doc_id {id_type}, part int, start bigint, n_tokens int, ids array<int>")
    (
        files.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "lz4")  # ids are packed to their bits already
        .orc(path)
    )
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files with ``start`` counted over all files, and the CRC-32 of their ids."""
    files = spark.read.orc(path)
    id_type = dict(files.dtypes)["doc_id"]
    # One row per file.
    bases = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = bases.select(F.col("part").alias("p"), F.expr("sum(n) OVER (ORDER BY part) - n").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            data = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            sums = [zlib.crc32(data[b:e]) for b, e in zip(np.concatenate([[0], ends[:-1]]), ends)]
            columns = [batch.column(c) for c in ("doc_id", "part", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], ["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(run, f"doc_id {id_type}, part int, start bigint, n_tokens int, ids_crc32 bigint")
    rows = rows.join(F.broadcast(bases), F.col("part") == F.col("p"))
    return rows.select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32"
    )
