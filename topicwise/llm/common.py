"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import time
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwise.session import scratch_dir

#: Rows of a join side that may be broadcast; each has a few short fields, so that side stays under about 30 MB.
BROADCAST_ROWS = 200_000
#: Bits of the table that holds back rows before a shuffle: 8 MB.
BITMAP_BITS = 1 << 26
#: Spark's option by which the shuffle files of a query go when it ends, not when the driver's memory is next tidied up.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's option for the rows of a batch that goes to Python, and how many where rows hold texts: a few MB, not 10,000 texts.
BATCH_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Share of the driver's heap beyond which ``stage`` tidies up, and the seconds from one time to the next at least.
HEAP_SHARE, TIDY_SECONDS = 0.5, 10
#: When ``stage`` last did.
_TIDIED = [0.0]
#: Folders of the staged tables that are still there.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stage(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives the loss of any executor.

    Nothing reads the shuffle files of the write once it has ended, so they go at once. ``batch_rows`` bounds the rows of the
    batches that the write sends to Python: each task holds one in the JVM and one in Python.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    options = {DROP_SHUFFLES: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    del df  # with the plan, what it has broadcast
    tidy(spark)
    table = spark.read.parquet(path)
    _FOLDERS[table] = path
    return table


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has grown beyond ``HEAP_SHARE`` of what it may.

    The tables that ended queries have broadcast stay in the driver's memory until a collection of all of the heap finds them
    unused. A heap with room to grow puts that off, grows instead and keeps its size, so a longer job needs a larger driver.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if time.monotonic() - _TIDIED[0] >= TIDY_SECONDS and runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        gc.collect()  # Python's unused frames hold plans
        spark._jvm.java.lang.System.gc()
        _TIDIED[0] = time.monotonic()


def give_back() -> None:
    """Give the memory that Python has freed back to the system, where the C library can; else it stays with the process."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def drop(*tables: DataFrame) -> None:
    """Delete staged tables whose results are staged themselves. Frames derived from them cannot be read any more."""
    for table in tables:
        if folder := _FOLDERS.pop(table, None):
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df``, a staged table of short rows, has at most ``rows`` rows."""
    return df.count() <= rows


def maybe_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose hash ``key`` is not in ``keys``: what passes has still to be joined.

    A bit per key, in a table of ``BITMAP_BITS`` bits that is broadcast whatever the number of keys; the fuller it gets, the
    less it holds back.
    """
    place = lambda c: F.pmod(F.col(c), F.lit(BITMAP_BITS))
    part, bit = F.shiftright(place(key), 15), place(key).bitwiseAND(F.lit(32767))
    bits = keys.select(part.alias("_part"), bit.alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), part == F.col("_part"))
    return found.filter(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0).select(*rows.columns)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The same table of the hashes in the one column of ``hashes``, for Python workers: 8 MB whatever their number."""
    place = F.pmod(hashes.columns[0], F.lit(BITMAP_BITS))
    rows = hashes.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit(32767)).alias("bit"))
    bits = np.zeros(BITMAP_BITS // 8, "uint8")
    for r in rows.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        bits[4096 * r["part"] : 4096 * (r["part"] + 1)] = np.frombuffer(r["bits"], "uint8")
    return bits


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``hashes`` may be in a ``bitmap``."""
    spot = hashes & np.uint64(BITMAP_BITS - 1)
    return (bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype("uint8") & 1).astype(bool)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the fast way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
