"""Grouping of spelling variants: words one edit apart, each led to its most frequent neighbour.

Two words one edit apart share their first half or their last half (of the shorter one's length), so words are dealt to groups of
one length, side and half. A group that is still large is dealt again by the halves of what its words do not share yet; each
time that leaves half of the rest, and the last groups are bounded by the alphabet. Inside a group the words are a sorted list,
and each is compared with those after it: the rows of the edit matrix, three cells wide, are kept for the prefix that
neighbours in the list share, and a prefix that is already two edits away skips all words that have it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwise.llm.common import ascii_lower, small, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value of the contract: what is a run of letters.
NO_LETTERS = "[^A-Za-zÀ-ÿ]+"
#: Words of a group that one task compares; larger groups are dealt again.
GROUP_WORDS = 1_000
PAIR = "a string, n_a bigint, b string, n_b bigint"


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", at_least: int = 1) -> DataFrame:
    """(doc, run): every run of letters with ``at_least`` code points, A-Z lower-cased. Null texts have none."""
    each = docs.select(F.col(id_col).alias("doc"), F.explode(F.split(text_col, NO_LETTERS)).alias("run"))
    return each.filter(F.length("run") >= max(at_least, 1)).select("doc", ascii_lower(F.col("run")).alias("run"))


def vocabulary(words: DataFrame, at_least: int, min_length: int) -> DataFrame:
    """(word, n) of the column ``word`` of ``words``: how often words of ``min_length`` code points or more stand, if ``at_least`` times."""
    counts = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= at_least)


def _halves(rows: DataFrame) -> DataFrame:
    """Deal each row to the group of the first and of the last half of what its group's words do not share yet.

    ``low`` and ``high`` code points are shared at the start and at the end. Pairs that share both halves are left to the group
    of the first: in that of the last half, ``apart`` says where words must differ.
    """
    rest = F.col("m") - F.col("low") - F.col("high")
    half = F.expr("CAST((m - low - high) DIV 2 AS INT)")
    size = F.length("word")
    first = F.substring(F.col("word"), F.col("low") + 1, half)
    last = F.substring(F.col("word"), size - F.col("high") - half + 1, half)
    ways = F.array(
        F.struct(F.concat("key", F.lit("<"), first).alias("key"), (F.col("low") + half).alias("low"), F.col("high").alias("high"), F.col("apart").alias("apart")),
        F.struct(
            F.concat("key", F.lit(">"), last).alias("key"),
            F.col("low").alias("low"),
            (F.col("high") + half).alias("high"),
            F.concat("apart", F.array(F.struct(F.col("low").alias("at"), half.alias("n")))).alias("apart"),
        ),
    )
    return rows.filter(rest >= 2).select("word", "n", "m", F.inline(ways))


def near_pairs(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(a, n_a, b, n_b): each pair of ``words`` (word, n; staged, unique, not empty) exactly one edit apart, once."""
    none = F.array().cast("array<struct<at:int,n:int>>")
    size = F.length("word")
    start = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter("m >= 1")
    rows = start.select("word", "n", "m", F.col("m").cast("string").alias("key"), F.lit(0).alias("low"), F.lit(0).alias("high"), none.alias("apart"))
    # A single code point has no halves: all words of one or two are one group, bounded by the alphabet.
    ready, rows = [rows.filter("m < 2")], _halves(rows)
    while True:
        rows = stage(rows, "word-groups")
        large = rows.filter("m - low - high >= 2").groupBy("key").count().filter(F.col("count") > group_words)
        large = stage(large.select("key", F.lit(True).alias("large")), "large-groups")
        marked = rows.join(F.broadcast(large) if small(large) else large, "key", "left")
        ready.append(marked.filter("large IS NULL").drop("large"))
        if not large.limit(1).count():
            break
        rows = _halves(marked.filter("large").drop("large"))
    everything = ready[0]
    for part in ready[1:]:
        everything = everything.unionByName(part)
    grouped = everything.repartition("key").sortWithinPartitions("key", "word")
    return grouped.select("key", "word", "n", "m", "low", "high", "apart").mapInArrow(_scan_groups, PAIR)


def _scan_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each group of rows with one key; a group that a batch cuts is kept until its rest comes."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        keys = np.array(table["key"].to_pylist(), object)
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([0])
        rest = table.slice(int(begins[-1]))
        yield from _pairs(table.slice(0, int(begins[-1])), begins)
    if rest is not None and rest.num_rows:
        yield from _pairs(rest, np.array([0, rest.num_rows]))


def _pairs(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
    words, counts = table["word"].to_pylist(), table["n"].to_pylist()
    found = []
    for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if end - begin < 2:
            continue
        m, low, high, apart = (table[c][begin].as_py() for c in ("m", "low", "high", "apart"))
        group = words[begin:end]
        for i, j in one_edit([w[low : len(w) - high] for w in group]):
            a, b = group[i], group[j]
            if min(len(a), len(b)) == m and all(a[x["at"] : x["at"] + x["n"]] != b[x["at"] : x["at"] + x["n"]] for x in apart):
                found.append((a, counts[begin + i], b, counts[begin + j]))
        if len(found) >= 10_000:
            yield _batch(found)
            found = []
    if found:
        yield _batch(found)


def _batch(pairs: list[tuple]) -> pa.RecordBatch:
    a, n_a, b, n_b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n_a, pa.int64()), pa.array(b, pa.string()), pa.array(n_b, pa.int64())], ["a", "n_a", "b", "n_b"])


def one_edit(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places i < j of words of a list exactly one edit apart. Any order is right; a sorted list shares the most rows.

    Row d of the matrix says how far the first d letters of a word are from the first d-1, d and d+1 letters of the other, up to
    two. Rows hold for the next word as far as it shares letters with the word before.
    """
    n = len(words)
    shared = [0] * n
    for j in range(1, n):
        a, b, d = words[j - 1], words[j], 0
        while d < len(a) and d < len(b) and a[d] == b[d]:
            d += 1
        shared[j] = d
    lower = [n] * n  # next place that shares less
    for j in range(n - 2, -1, -1):
        k = j + 1
        while k < n and shared[k] >= shared[j]:
            k = lower[k]
        lower[j] = k
    for i in range(n - 1):
        q = words[i]
        rows = [(2, 0, 1), *[(1, 0, 1)] * len(q)]  # those of the word itself
        depth, j = len(q), i + 1
        while j < n:
            w = words[j]
            depth = min(depth, shared[j])
            size, (x, y, z) = len(w), rows[depth]
            while depth < size and (x < 2 or y < 2 or z < 2):
                c = w[depth]
                before = min(x + (depth == 0 or depth > len(q) or q[depth - 1] != c), y + 1)
                same = min(y + (depth >= len(q) or q[depth] != c), z + 1, before + 1)
                after = min(z + (depth + 1 >= len(q) or q[depth + 1] != c), same + 1)
                x, y, z = before, same, after
                depth += 1
                rows[depth:] = [(x, y, z)]
            if depth == size and abs(size - len(q)) < 2 and (x, y, z)[len(q) - size + 1] == 1:
                yield i, j
            if x >= 2 and y >= 2 and z >= 2:
                j = j + 1
                while j < n and shared[j] >= depth:
                    j = lower[j]
            else:
                j += 1


def variants(words: DataFrame, ratio: int = 5, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per word of ``words`` (word, n): word, n, n_near (words exactly one edit away), form (the most frequent of them, the
    smallest of equals, if it stands ``ratio`` times as often or more, else null), form_n, root (where forms lead to in the end).

    Words must be unique; null words, empty words and words without a count are left out. An empty table gives no rows.
    Other columns are ignored.
    """
    words = stage(words.filter("word <> '' AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    pairs = stage(near_pairs(words, group_words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("minus"), "b")).alias("best"))
    linked = words.join(best, F.col("word") == F.col("a"), "left")
    likely = -F.col("best.minus") >= ratio * F.col("n")
    rows = linked.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(likely, F.col("best.b")).alias("form"),
        F.when(likely, -F.col("best.minus")).alias("form_n"),
    )
    rows = stage(rows, "forms")
    roots = _roots(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", F.col("word")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): every step doubles the way. Counts grow along it, so it ends and has at most log(largest count) forms."""
    steps = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while steps.filter("moved").limit(1).count():
        onward = steps.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        onward = F.broadcast(onward) if small(onward) else onward
        jumped = steps.join(onward, F.col("root") == F.col("_from"), "left")
        steps = stage(jumped.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots")
    return steps.select("word", "root")
