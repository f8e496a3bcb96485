"""MinHash near-duplicates by tensored banding.

Two small collections of hash groups, A_1..A_m and B_1..B_m, give m x m tables: the key of table (i, j) is (A_i, B_j). So the
number of minhashes grows with the square root of the number of tables. A pair meets in a table only if it shares an A and a
B; keys are built only from groups that some other text shares, which loses nothing. Links are confirmed on full sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwise.llm.common import TEXT_ROWS, maybe_among, stage
from topicwise.llm.similar import connect

PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words (A-Z lower-cased, cut at ASCII white space); a shorter text is one run."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "uint64")
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, "uint64")
    for k in range(width):
        total = (total ^ codes[k : k + len(total)]) * PRIME
        total ^= total >> np.uint64(32)
    return np.unique(total)


def shingles_of_lines(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of each line, one after another, and where each line's begin. There are lines, and every line has a word."""
    split = [line.encode("utf-8", "surrogatepass").lower().split() for line in lines]
    n = np.array([len(x) for x in split], "int64")
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(split)), "uint64", int(n.sum()))
    begins, sets = np.cumsum(n) - n, np.maximum(n - size + 1, 1)
    starts = np.cumsum(sets) - sets
    total = np.full(max(len(codes) - size + 1, 0), size, "uint64")
    for k in range(size):
        total = (total ^ codes[k : k + len(total)]) * PRIME
        total ^= total >> np.uint64(32)
    # Runs that cross the end of a line go. A line with fewer words is one run, whose place here is taken by any other.
    total = np.append(total, np.zeros(len(codes) - len(total), "uint64"))
    total = total[np.repeat(begins - starts, sets) + np.arange(int(sets.sum()))]
    for i in np.flatnonzero(n < size):
        total[starts[i]] = shingles(lines[i], size)[0]
    for a, b in zip(starts.tolist(), (starts + sets).tolist()):
        total[a:b].sort()
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[starts] = True
    return total[new], (np.cumsum(new) - 1)[starts]


def digests(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``digest`` of each set, as rows."""
    data, ends = memoryview(items).cast("B"), [*starts[1:].tolist(), len(items)]
    found = b"".join([xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(starts.tolist(), ends)])
    return np.frombuffer(found, "int64").reshape(-1, 2)


def digest(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), "int64").tolist())


class Hashes:
    """``groups`` x 2 groups of ``rows`` minhashes: multiplication by fixed odd numbers."""

    def __init__(self, groups: int, rows: int, seed: int):
        self.shape = (2, groups, rows)
        self.factors = (np.random.default_rng(seed).integers(0, 1 << 63, 2 * groups * rows, "uint64") << np.uint64(1)) | np.uint64(1)

    def keys(self, items: np.ndarray) -> np.ndarray:
        """2 x groups keys."""
        low = np.full(len(self.factors), np.iinfo("uint64").max, "uint64")
        for i in range(0, len(items), 2048):
            np.minimum(low, (items[None, i : i + 2048] * self.factors[:, None]).min(axis=1), out=low)
        return self._mixed(low.reshape(self.shape))

    def keys_of(self, items: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``keys`` of each set (none is empty), as rows; the sets stand one after another and begin at ``starts``."""
        low = np.empty((len(starts), len(self.factors)), "uint64")
        for i, factor in enumerate(self.factors):
            low[:, i] = np.minimum.reduceat(items * factor, starts)
        return self._mixed(low.reshape(-1, *self.shape)).reshape(len(starts), -1)

    def _mixed(self, low: np.ndarray) -> np.ndarray:
        total = np.zeros(low.shape[:-1], "uint64")
        for r in range(self.shape[2]):
            total = (total ^ low[..., r]) * PRIME
            total ^= total >> np.uint64(29)
        return total.view("int64")


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    groups: int = 12,
    rows: int = 3,
    seed: int = 11,
    with_group: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept.

    A pair at exactly ``percent`` 80 meets in one of groups^2 = 144 tables with probability (1 - (1 - 0.8^3)^12)^2 = 0.9996,
    a pair at 90 practically always. ``component_id`` is the smallest id reachable by links; null and empty texts link with
    nothing. Repeated rows get the same result each. A component of null ids only has a null id; ``kept`` compares
    null-safely. Other columns are ignored. ``with_group`` adds ``group``, a number of the component that does not depend on ids
    (null without words).
    """
    id_type = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    signed = stage(_signed(source, words, Hashes(groups, rows, seed), id_type), "signatures", TEXT_ROWS)

    # Texts with equal sets are one class with an id of its own.
    classes = signed.filter("n > 0").groupBy("k1", "k2").agg(
        F.min("doc").alias("smallest"), F.max(F.struct("doc", "text_hash")).alias("row"), F.first("keys").alias("keys")
    )
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    tables = _tables(classes, groups)

    def sets_of(ids: DataFrame) -> DataFrame:
        """Sets of classes, from the text of one of their rows."""
        wanted = classes.join(ids, "id").select("id", F.col("row.doc").alias("d"), F.col("row.text_hash").alias("h"), "k1", "k2")
        wanted = stage(wanted, "wanted")
        few = maybe_among(source, "text_hash", wanted.select(F.col("h").alias("text_hash")))
        texts = few.join(wanted, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
        return _sets(texts, words).dropDuplicates(["id"])

    found = connect(tables, sets_of, percent)
    named = classes.join(found, "id", "left").select("k1", "k2", "smallest", F.coalesce("component", "id").alias("component"))
    named = stage(named, "classes-named")
    heads = named.groupBy("component").agg(F.min("smallest").alias("head"))
    result = named.join(heads, "component").select("k1", "k2", "head", F.col("component").alias("group"))
    out = signed.join(result, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("doc"))
    return out.select(
        F.col("doc").alias("doc_id"),
        "text_hash",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc").eqNullSafe(component).alias("kept"),
        *(["group"] if with_group else []),
    )


def _signed(source: DataFrame, words: int, hashes: Hashes, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                items = shingles(text, words)
                k1, k2 = digest(items)
                n.append(len(items))
                high.append(k1)
                low.append(k2)
                keys.append(hashes.keys(items).ravel() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("text_hash"), *(pa.array(c, pa.int64()) for c in (n, high, low)), pa.array(keys, pa.list_(pa.int64()))],
                ["doc", "text_hash", "n", "k1", "k2", "keys"],
            )

    return source.mapInArrow(run, f"doc {id_type}, text_hash bigint, n bigint, k1 bigint, k2 bigint, keys array<bigint>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = [], []
            columns = (batch.column(c).to_pylist() for c in ("id", "text", "k1", "k2"))
            for id_, text, k1, k2 in zip(*columns):
                items = shingles(text, words)
                if digest(items) == (k1, k2):  # else another text with the same id and hash
                    ids.append(id_)
                    sets.append(items.view("int64"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "items"])

    return texts.select("id", "text", "k1", "k2").mapInArrow(run, "id bigint, items array<bigint>")


def _tables(classes: DataFrame, groups: int) -> DataFrame:
    """(table, id) for every table key built from an A and a B that another class shares."""
    halves = classes.select("id", F.posexplode("keys").alias("slot", "key"))
    shared = halves.groupBy("slot", "key").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("slot", "key")
    halves = halves.join(shared, ["slot", "key"]).groupBy("id").agg(F.collect_list(F.struct("slot", "key")).alias("halves"))
    left = F.explode(F.filter("halves", lambda h: h["slot"] < groups)).alias("a")
    pairs = halves.select("id", "halves", left).select("id", "a", F.explode(F.filter("halves", lambda h: h["slot"] >= groups)).alias("b"))
    return pairs.select(F.xxhash64("a.slot", "b.slot", "a.key", "b.key").alias("table"), "id")
