"""Packing by concatenate and cut: one global token stream, laid out by two prefix sums, cut into fixed windows.

Pass one encodes every text once and writes, per task, ids with running starts; the tasks' totals give each part its place
in the stream. Pass two cuts windows. Windows inside a run of documents leave a task whole; what a task has of a window
that its neighbour shares leaves as a boundary record, and boundary records of one window are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwise.llm.common import TEXT_ROWS, stage
from topicwise.llm.tokens import encoded

DOCS = "array<struct<offset:bigint,doc_id:{id},start:bigint,length:bigint,doc_tokens:bigint>>"


def pack(
    docs: DataFrame, tokenizer: str, *, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Return one row per sequence: sequence_id, n_tokens, ids (little-endian unsigned 32-bit), docs.

    ``docs`` lists the pieces in order: offset in the sequence, doc_id, start in the document's ids, length, doc_tokens.
    Every sequence has ``length`` ids but the last. Null and empty texts are the end id alone; repeated rows and null ids
    are documents like others; an empty table gives no row; other columns are ignored.
    """
    id_type = dict(docs.dtypes)[id_col]
    tokens = stage(_encode(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tokenizer, end_id, id_type), "tokens", TEXT_ROWS)

    # One row per task of pass one, so the driver holds no more than it does for that job's tasks anyway.
    bases, total = {}, 0
    for row in tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        bases[row["part"]], total = total, total + row["n"]

    schema = f"sequence_id bigint, first bigint, n_tokens bigint, ids binary, docs {DOCS.format(id=id_type)}"
    cut = tokens.select("part", "start", "id", "n", "ids").mapInArrow(lambda b: _cut(b, bases, length), schema)
    columns = ["sequence_id", "n_tokens", "ids", "docs"]
    whole = cut.filter(F.col("n_tokens") == length).select(*columns)
    shared = (
        cut.filter(F.col("n_tokens") < length)
        .groupBy("sequence_id")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("first", "ids", "docs"))).alias("runs"))
        .select(
            "sequence_id",
            "n_tokens",
            F.expr("aggregate(runs, X'', (all, run) -> concat(all, run.ids))").alias("ids"),
            F.flatten(F.col("runs.docs")).alias("docs"),
        )
    )
    return whole.unionByName(shared)


def _encode(docs: DataFrame, tokenizer: str, end_id: int, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch, ids in encoded(batches, tokenizer, "text", end_id):
            n = np.array([len(x) // 4 for x in ids], "int64")
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            # Ids under 65,536 take two bytes in this table.
            values = [np.frombuffer(x, "<u4") for x in ids]
            packed = [v.astype("<u2").tobytes() if v.max() < 65536 else v.tobytes() for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part)), pa.array(starts), batch.column("id"), pa.array(n), pa.array(packed, pa.binary())],
                ["part", "start", "id", "n", "ids"],
            )

    return docs.mapInArrow(run, f"part bigint, start bigint, id {id_type}, n bigint, ids binary")


def _cut(batches: Iterator[pa.RecordBatch], bases: dict[int, int], length: int) -> Iterator[pa.RecordBatch]:
    """Windows of each run of neighbouring documents. ``open`` holds the pieces of the window that is being filled."""
    at, window, first, pieces, kind = None, None, 0, [], None
    done: list[tuple] = []

    def close():
        if pieces:
            docs = [{k: v for k, v in zip(("offset", "doc_id", "start", "length", "doc_tokens"), p[:5])} for p in pieces]
            done.append((window, first, sum(p[3] for p in pieces), b"".join(p[5] for p in pieces), docs))
            pieces.clear()

    def batch() -> pa.RecordBatch:
        doc = pa.struct(
            [("offset", pa.int64()), ("doc_id", kind), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())]
        )
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(doc)]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*done), types)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["sequence_id", "first", "n_tokens", "ids", "docs"])

    for rows in batches:
        kind = rows.column("id").type
        for part, start, doc, n, ids in zip(*(rows.column(c).to_pylist() for c in ("part", "start", "id", "n", "ids"))):
            begin = bases[part] + start
            if len(ids) == 2 * n:
                ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            if begin != at:
                close()
                window = None
            at, done_ids = begin + n, 0
            while done_ids < n:
                here, offset = divmod(begin + done_ids, length)
                if here != window:
                    close()
                    window, first = here, offset
                take = min(n - done_ids, length - offset)
                pieces.append((offset, doc, done_ids, take, n, ids[4 * done_ids : 4 * (done_ids + take)]))
                done_ids += take
            if len(done) >= 1000:
                yield batch()
    close()
    if done:
        yield batch()
