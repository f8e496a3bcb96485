"""Alignment of two tokenizers over the same texts, with the documents that hold each linked pair of tokens counted over the corpus.

A text (a space put before it) is cut where both tokenizers always end a token: before a space that follows something that is not
white space. These units repeat, so each worker aligns a unit once and keeps what it found (bounded). First pass: every task
counts, per pair of ids, the documents that hold it. The distinct pairs are dealt to buckets by hash, and each bucket builds a
minimal perfect hash: levels of bits, each pair on the first level where it has a bit for itself, its index the number of bits
before. The tasks' counts become dense vectors under that index, summed as a tree. Second pass: the links that the first one wrote
down are read again and each pair's count is looked up; the stored key at its index tells whether it is the pair asked for.

The pairs of highest count go to every worker, as many as ``local_pairs`` allows; those beyond are rarer than all of these, and are
counted by a join.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import sys
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicwise.llm.common import TEXT_ROWS, stage
from topicwise.llm.tokens import byte_alphabet

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Units that a worker keeps, in two generations of this size; longer units are aligned each time.
KEPT_UNITS = 150_000
KEPT_LENGTH = 64
#: Pairs that a task counts before it hands them on.
TASK_PAIRS = 500_000
#: Pairs of one bucket, on average, and rows that become one dense vector, on average.
BUCKET_PAIRS = 16_384
VECTOR_ROWS = 65_536
#: Vectors that are summed at a time.
FAN_IN = 16
#: Links whose counts are looked up together, or those of one text.
LINKS = 500_000
#: Pairs whose counts every worker holds, at about 30 bytes with the hash: 60 MB.
LOCAL_PAIRS = 2_000_000

UNIT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
#: Fixed value: what the second tokenizer writes for a space.
SPACE = "▁"
TOTALS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Links(NamedTuple):
    """Tokens and links of some units, end to end in the order of the units; ``upto_*`` are the places after each unit's last."""

    sizes: list[tuple[int, int, int]]  # A tokens, B tokens, groups of each unit
    upto_token: list[int]
    signs: np.ndarray  # of all tokens, each group's A side before its B side: text of the id with the sign that follows
    upto_link: np.ndarray
    pairs: np.ndarray  # of all links: a << 32 | b

    def groups(self) -> list[str]:
        signs, start, out = self.signs.tolist(), 0, []
        for end in self.upto_token:
            out.append("".join(signs[start:end])[:-1])
            start = end
        return out


class Aligner:
    """Aligns texts unit by unit."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        alphabet = byte_alphabet()
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in sizes], np.int64) for sizes in (self.bytes_a, self.bytes_b))
        # Ids as text, with the sign that follows inside a side of a group and at its end.
        self.text_a = np.array([[f"{i}," for i in range(len(self.bytes_a))], [f"{i}|" for i in range(len(self.bytes_a))]], object)
        self.text_b = np.array([[f"{i}," for i in range(len(self.bytes_b))], [f"{i};" for i in range(len(self.bytes_b))]], object)
        self.run = None

    def start(self, run: str) -> None:
        """Forget what was kept for another run."""
        if self.run != run:
            self.run = run
            self.new: dict[str, object] = {}
            self.old: dict[str, object] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def units(self, text: str) -> list[str] | None:
        """Units of a space and the text; None for a text without tokens: empty, or with a character that reads back as a space."""
        return None if not text or SPACE in text else UNIT.split(f" {text}")

    def learn(self, texts: list[list[str] | None], make: Callable[[Links], list]) -> None:
        """Align the units of a batch that are not known yet, and keep what ``make`` gives for each; None if it does not read back."""
        here = set().union(*filter(None, texts))
        if len(self.new) + len(here) > KEPT_UNITS:
            self.old, self.new = self.new, {}
        unknown = []
        for u in here.difference(self.new):
            if u in self.old:
                self.new[u] = self.old[u]
            else:
                unknown.append(u)
        # A unit that ends in white space is cut from the next one by the text's end alone, so it is encoded by itself.
        alone = [u for u in unknown if u[-1].isspace()]
        rest = [u for u in unknown if not u[-1].isspace()]
        for part in [*([u] for u in alone), *(rest[i : i + 8192] for i in range(0, len(rest), 8192))]:
            self._learn_part(part, make)

    def _learn_part(self, units: list[str], make: Callable[[Links], list]) -> None:
        """Align units encoded as one text, or, if that does not read back, each by itself."""
        found = self._align(units)
        if found:
            self.new.update(zip(units, make(found)))
        elif len(units) == 1:
            self.new[units[0]] = None
        else:
            for u in units:
                self._learn_part([u], make)

    def forget_long(self) -> None:
        for u in [u for u in self.new if len(u) > KEPT_LENGTH]:
            del self.new[u]

    def _align(self, units: list[str]) -> Links | None:
        """All of ``units`` at once. Their bytes lie end to end, so a byte offset tells unit and group."""
        text = "".join(units)
        data = text.encode()
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text[1:]), np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != data or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != data:
            return None
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in units])
        groups = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_group = np.searchsorted(groups, ends)
        if not (groups[np.minimum(last_group, len(groups) - 1)] == ends).all():
            return None
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        # Texts of the groups: the tokens of each group's A side, then of its B side, each with the sign after it.
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        signs = np.concatenate([self.text_a[last_a.astype(int), a], self.text_b[last_b.astype(int), b]])[order]
        # Links: each A token with all B tokens of its group.
        n_b = np.bincount(group_b, minlength=len(groups))
        width = n_b[group_a]
        links = np.cumsum(width)
        nth = np.arange(links[-1]) - np.repeat(links - width, width)
        pairs = np.repeat(a, width) << 32 | b[np.repeat((np.cumsum(n_b) - n_b)[group_a], width) + nth]
        upto_a, upto_b = np.searchsorted(ends_a, ends, side="right"), np.searchsorted(ends_b, ends, side="right")
        sizes = zip(*(np.diff(upto, prepend=0).tolist() for upto in (upto_a, upto_b, last_group + 1)))
        return Links(list(sizes), (upto_a + upto_b).tolist(), signs, links[upto_a - 1], pairs)


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _aligned(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], run: str, make: Callable[[Links], list], chars: int = 800_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with what ``make`` gives for the units of their texts (column 0), None for a text without tokens."""
    tool = aligner(*paths)
    tool.start(run)
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= chars or i == len(texts) - 1:
                cut = [tool.units(t) for t in texts[start : i + 1]]
                tool.learn(cut, make)
                get = tool.new.__getitem__
                found = [units and list(map(get, units)) for units in cut]
                yield batch.slice(start, i + 1 - start), [None if not units or None in units else units for units in found]
                tool.forget_long()
                start, size = i + 1, 0


def _parts(found: Links) -> list[tuple]:
    """Sizes, text of the groups, and linked pairs (8 bytes each) of each unit."""
    data, ends = found.pairs.tobytes(), (8 * found.upto_link).tolist()
    return list(zip(found.sizes, found.groups(), (data[b:e] for b, e in zip([0, *ends[:-1]], ends))))


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """First pass over (text, doc_id): a row per document, ``links`` being the pairs of all its links, 8 bytes each; and rows that
    have but (task, pair, n): documents that hold a linked pair, as far as one task counted; a pair may come again in another row."""
    counted = [T.StructField("task", T.IntegerType()), T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())]
    fields = [docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in TOTALS[:4]], T.StructField("groups_sha256", T.StringType())]
    fields += [T.StructField("groups", T.StringType()), T.StructField("row", T.StringType()), T.StructField("links", T.BinaryType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*fields, *counted]])
    run = uuid.uuid4().hex

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: Counter = Counter()
        task, done = TaskContext.get().partitionId(), 0
        kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.binary(), pa.int32(), pa.int64(), pa.int64()]
        id_type = pa.null()

        def rows() -> pa.RecordBatch:
            keys = np.fromiter(held.keys(), np.int64, len(held))
            n = np.fromiter(held.values(), np.int64, len(held))
            columns = [pa.nulls(len(keys), kind) for kind in [id_type, *kinds[:8]]]
            columns += [pa.array(np.full(len(keys), task, np.int32)), pa.array(keys), pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch, texts in _aligned(batches, (path_a, path_b), run, _parts):
            id_type = batch.schema.field(1).type
            totals, digests, groups, links = [], [], [], []
            for units in texts:
                sizes, parts, pairs = zip(*units) if units else ([(0, 0, 0)], [""], [b""])
                text, pairs = ";".join(parts), b"".join(pairs)
                totals.append([*map(sum, zip(*sizes)), len(pairs) // 8])
                digests.append(hashlib.sha256(text.encode()).hexdigest() if units else "")
                groups.append(text if with_groups else None)
                links.append(pairs)
                held.update(set(memoryview(pairs).cast("q")))
                if len(held) > TASK_PAIRS:
                    yield rows()
                    held.clear()
            names = [f"{task}-{done + i}" for i in range(len(texts))]
            done += len(texts)
            columns = [*zip(*totals), digests, groups, names, links, *[[None] * len(texts)] * 3]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], schema.names)
        if held:
            yield rows()

    return docs.mapInArrow(first, schema)


# Minimal perfect hash ---------------------------------------------------------------------------------------------------------


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys, -1) % np.uint64(buckets)).astype(np.int32)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and their bits, end to end, for different ``keys``: as many bits are set as there are keys."""
    sizes, levels = [], []
    while len(keys):
        size = max(int(1.5 * len(keys)), 1)
        place = (mix(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        keys = keys[~alone[place]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


class PerfectHash:
    """Index from 0 of each of the keys it was built from; other keys get -1 or the index of some key."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.cumsum(bits, dtype=np.min_scalar_type(len(bits)))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, start = np.full(len(keys), -1, np.int64), 0
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = start + (mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]].astype(np.int64) - 1
            left, start = left[~hit], start + size
        return out


def _stored(sizes: list[int], bits: np.ndarray) -> tuple[list[int], bytes]:
    return sizes, np.packbits(bits).tobytes()


def _loaded(sizes, bits: bytes) -> PerfectHash:
    sizes = [int(s) for s in sizes]
    return PerfectHash(sizes, np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool))


HASHES = "bucket int, sizes array<bigint>, bits binary, keys binary"


def perfect_hashes(pairs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, sizes, bits, keys) for the different ``pairs`` (bucket, pair); ``keys`` lie at their index."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["pair"].to_numpy(np.int64)
        sizes, bits = build_hash(keys)
        at = np.empty(len(keys), np.int64)
        at[PerfectHash(sizes, bits)(keys)] = keys
        return pd.DataFrame([(rows["bucket"].iloc[0], *_stored(sizes, bits), at.tobytes())], columns=["bucket", "sizes", "bits", "keys"])

    return pairs.select("bucket", "pair").distinct().groupBy("bucket").applyInPandas(build, HASHES)


def summed(counts: DataFrame, hashes: DataFrame, slices: int) -> DataFrame:
    """(bucket, counts): the dense vector of each bucket's counts, by the index of its hash.

    ``counts`` (bucket, slice, pair, n) becomes one vector per bucket and slice; then ``FAN_IN`` vectors at a time are added.
    """

    def dense(rows: pd.DataFrame, hashed: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"bucket": np.zeros(0, np.int32), "slice": np.zeros(0, np.int64), "counts": np.zeros(0, object)})
        h = hashed.iloc[0]
        keys, pairs = np.frombuffer(h["keys"], np.int64), rows["pair"].to_numpy(np.int64)
        at = _loaded(h["sizes"], h["bits"])(pairs)
        if not (keys[at] == pairs).all():
            raise ValueError("a counted pair is not in the hash")
        vector = np.zeros(len(keys), np.int64)
        np.add.at(vector, at, rows["n"].to_numpy(np.int64))
        return pd.DataFrame([(h["bucket"], rows["slice"].iloc[0], vector.tobytes())], columns=["bucket", "slice", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = functools.reduce(np.add, (np.frombuffer(v, np.int64) for v in rows["counts"]))
        return pd.DataFrame([(rows["bucket"].iloc[0], rows["slice"].iloc[0] // FAN_IN, total.tobytes())], columns=["bucket", "slice", "counts"])

    fields = "bucket int, slice bigint, counts binary"
    spread = hashes.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))
    vectors = counts.groupBy("bucket", "slice").cogroup(spread.groupBy("bucket", "slice")).applyInPandas(dense, fields)
    while slices > 1:
        vectors = vectors.groupBy("bucket", F.expr(f"slice DIV {FAN_IN}").alias("_up")).applyInPandas(add, fields)
        slices = -(-slices // FAN_IN)
    return vectors.select("bucket", "counts")


def count_table(partial: DataFrame) -> tuple[DataFrame, int]:
    """The counts ``partial`` (task, pair, n; staged) summed per pair: a staged table (bucket, sizes, bits, keys, counts), keys and
    counts by the index of the bucket's hash, and the number of buckets."""
    buckets = max(-(-partial.agg(F.count_distinct("pair")).first()[0] // BUCKET_PAIRS), 1)
    slices = max(-(-partial.count() // (buckets * VECTOR_ROWS)), 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("pair").to_numpy()
            part = b.column("task").to_numpy().astype(np.int64) % slices
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(keys, buckets)), pa.array(part), b.column("pair"), b.column("n")], ["bucket", "slice", "pair", "n"])

    placed = partial.select("task", "pair", "n").mapInArrow(place, "bucket int, slice bigint, pair bigint, n bigint")
    hashes = stage(perfect_hashes(placed, buckets), "pair-hashes")
    return stage(hashes.join(summed(placed, hashes, slices), "bucket"), "pair-table"), buckets


def pair_rows(table: DataFrame) -> DataFrame:
    """(pair, n) of a count table."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["pair", "n"])

    return table.select("keys", "counts").mapInArrow(each, "pair bigint, n bigint")


class Lookup:
    """Counts of pairs by the buckets' hashes, each answer checked against the key stored at its index; unknown pairs count 0."""

    def __init__(self, rows: list[tuple], buckets: int):
        self.buckets = buckets
        self.tables = {b: (_loaded(sizes, bits), np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)) for b, sizes, bits, keys, counts in rows}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, bucket = np.zeros(len(keys), np.int64), bucket_of(keys, self.buckets)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part) and bucket[part[0]] in self.tables:
                hashed, stored, counts = self.tables[bucket[part[0]]]
                at = hashed(keys[part])
                good = at >= 0
                good[good] = stored[at[good]] == keys[part][good]
                out[part[good]] = counts[at[good]]
        return out


def _local(pairs: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` pairs have it or more, among the ends of 64 x 8 ranges of counts."""
    steps = pairs.groupBy(F.floor(F.log2("n") * 8).alias("range")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    least, total = 1 << 62, 0
    for row in sorted(steps.collect(), key=lambda r: -r["range"]):
        total += row["k"]
        if total > most:
            break
        least = row["least"]
    return least


def align(
    docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", local_pairs: int = LOCAL_PAIRS, with_groups: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id), count_sum
    (counts of all links), groups_sha256, and ``groups`` itself if asked for.

    A link is an A and a B token of one group, a group what lies between offsets where both tokenizers end a token; its count is the
    number of documents of ``docs`` that hold the pair of ids linked. Null and empty texts, and texts that either tokenizer does
    not give back byte for byte, have no tokens: zeros and ''. Repeated rows count as documents of their own and null ids are
    documents like others. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = stage(aligned_texts(docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")), path_a, path_b, with_groups), "texts-aligned", TEXT_ROWS)
    table, buckets = count_table(texts.filter("task IS NOT NULL").select("task", "pair", "n"))
    pairs = pair_rows(table)
    # One row per A id: bounded by the vocabulary.
    best = pairs.groupBy(F.shiftright("pair", 32).cast("int").alias("a")).agg(F.max("n").alias("best"))
    all_pairs = table.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 8
    least = 0
    if all_pairs > local_pairs:
        least = _local(pairs, local_pairs)
        head = stage(pairs.filter(F.col("n") >= least).select(F.lit(0).alias("task"), "pair", "n"), "frequent-pairs")
        table, buckets = count_table(head)
    held = [(r["bucket"], list(r["sizes"]), bytes(r["bits"]), bytes(r["keys"]), bytes(r["counts"])) for r in table.collect()]
    highest = best.collect()
    tops = np.zeros(max((r["a"] for r in highest), default=0) + 1, np.int64)
    tops[[r["a"] for r in highest]] = [r["best"] for r in highest]
    rows = _measured(texts.filter("task IS NULL").drop("task", "pair", "n"), spark.sparkContext.broadcast((held, buckets, tops)))
    # Written here, not by the caller, for the size of its batches: links take more room than texts.
    rows = stage(rows, "aligned", TEXT_ROWS)
    out = ["doc_id", *TOTALS, "groups_sha256", *(["groups"] if with_groups else [])]
    if not least:
        return rows.select(*out)
    rare = pairs.filter(F.col("n") < least).withColumn("a", F.shiftright("pair", 32).cast("int")).join(F.broadcast(best), "a")
    open_links = rows.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times")
    added = open_links.join(rare, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more")
    )
    more = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}
    return rows.join(added, "row", "left").withColumns(more).select(*out)


def _measured(texts: DataFrame, shared) -> DataFrame:
    """Second pass, over the rows of the first: counts of their links. ``rest`` are the linked pairs of a text whose count is not at
    hand, ``row`` names its row."""
    rest_type = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))
    added = [T.StructField(n, T.LongType()) for n in TOTALS[4:]]
    schema = T.StructType([f for f in texts.schema if f.name != "links"] + added + [T.StructField("rest", rest_type)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, buckets, tops = shared.value
        lookup = Lookup(held, buckets)
        kinds = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
        for whole in batches:
            links = np.cumsum(whole.column("n_links").to_numpy())
            # Slices that begin with a new multiple of so many links.
            first = np.flatnonzero(np.diff(links // LINKS, prepend=-1))
            for start, end in zip(first.tolist(), [*first[1:].tolist(), whole.num_rows]):
                batch = whole.slice(start, end - start)
                pairs = np.frombuffer(b"".join(batch.column("links").to_pylist()), np.int64)
                upto = np.cumsum(batch.column("n_links").to_numpy())
                distinct, place = np.unique(pairs, return_inverse=True)
                found = lookup(distinct)
                best = (found == tops[distinct >> 32]) & (found > 0)
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[place])])[upto], prepend=0) for x in (best, found)]
                rests: list[list] = [[] for _ in range(len(upto))]
                open_links = np.flatnonzero(found[place] == 0)
                owner = np.searchsorted(upto, open_links, side="right")
                for (row, pair), n in Counter(zip(owner.tolist(), pairs[open_links].tolist())).items():
                    rests[row].append({"pair": pair, "times": n})
                columns = [batch.column(c) for c in batch.schema.names if c != "links"]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums), pa.array(rests, kinds)], schema.names)

    return texts.mapInArrow(measure, schema)
