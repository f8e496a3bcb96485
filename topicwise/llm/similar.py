"""Classes of similar sets: from table keys to verified links to components, without all pairs of a group.

Only connectivity is wanted, so a pair is verified only while its sides are not yet connected:

1. each member of a table group against one member that all see, the smallest; sets with the same smallest member form a
   neighbourhood;
2. in neighbourhoods that still hold several components, whatever is outside the largest one against everything, block by
   block inside tasks. A block has a bounded number of items, and only links leave it.

So no candidate pair that is similar stays apart, and no list of pairs is ever built.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwise.llm.common import TEXT_ROWS, drop, stage
from topicwise.llm.graph import components, lookup

#: Sets of a block and their items, at most on average; two blocks are compared in one task.
BLOCK_SETS = 2000
BLOCK_ITEMS = 400_000
#: Items that many rows share are counted in matrix products of so many items; those of at most ``FEW_PAIRS`` pairs, pair by
#: pair, about ``PAIRS`` at a time.
COLUMNS, FEW_PAIRS, PAIRS = 1024, 4096, 500_000
#: Rows of a block that are compared at a time.
ROWS = 128


def connect(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(id, component) of the ids that have links; others are alone.

    ``rows`` is (table, id): the groups, ids of sets that share a table key. ``sets_of`` gives (id, items) for (id): arrays of
    distinct longs. Two sets are linked when 100 x common items >= ``percent`` x all items.
    """
    groups = rows.groupBy("table").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").drop("last")
    rows = stage(rows.join(groups, "table"), "groups")
    sets = stage(sets_of(rows.select("id").distinct()), "sets", TEXT_ROWS)
    sizes = stage(sets.select("id", F.size("items").alias("n")), "set-sizes")

    around = stage(rows.select(F.col("first").alias("hub"), "id").distinct(), "neighbourhoods")
    smallest = around.filter("id <> hub").groupBy(F.col("id").alias("a")).agg(F.min("hub").alias("b"))
    links = _verified(smallest, sets, sizes, percent)
    labels = _merge(None, links)
    more = _between_components(around, labels, sets, sizes, percent)
    merged = _merge(labels, more)
    drop(rows, sets, sizes, around, links, labels, more)
    return merged


def _between_components(around: DataFrame, labels: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each neighbourhood (hub, id), as pairs of components."""
    named = stage(_named(around, labels).join(sizes, "id").select("hub", "id", "component", "n"), "neighbourhoods-named")
    parts = named.groupBy("hub", "component").agg(F.count("*").alias("sets"), F.sum("n").alias("items"))
    # For each neighbourhood of several components: the largest of them, and how many blocks each side needs.
    largest = F.max(F.struct("sets", "component", "items"))
    mixed = parts.groupBy("hub").agg(
        largest.alias("top"), F.sum("sets").alias("sets"), F.sum("items").alias("items"), F.count("*").alias("parts")
    ).filter("parts > 1")
    blocks = lambda sets, items: F.ceil(F.greatest(sets / BLOCK_SETS, items / BLOCK_ITEMS)).cast("int")
    mixed = stage(
        mixed.select(
            "hub", F.col("top.component").alias("largest"), blocks(F.col("sets"), F.col("items")).alias("all_blocks"),
            blocks(F.col("sets") - F.col("top.sets"), F.col("items") - F.col("top.items")).alias("other_blocks"),
        ),
        "neighbourhoods-mixed",
    )
    inside = lookup(named.withColumnRenamed("hub", "h"), "h", mixed, "hub").select(
        "h", "id", "component", "largest", "other_blocks", "all_blocks",
        F.pmod(F.xxhash64("id"), "other_blocks").cast("int").alias("x"), F.pmod(F.xxhash64("id"), "all_blocks").cast("int").alias("y"),
    )
    # Task (i, j) compares block i of the others with block j of all. A set that is on both sides there goes there once.
    cells = lambda n, cell: F.transform(F.sequence(F.lit(0), F.col(n) - 1), cell)
    right = cells("other_blocks", lambda i: F.struct(i.alias("i"), F.col("y").alias("j")))
    left = cells("all_blocks", lambda j: F.struct(F.col("x").alias("i"), j.alias("j")))
    other = F.col("component") != F.col("largest")
    dealt = inside.select("*", F.explode(F.when(other, F.array_union(left, right)).otherwise(right)).alias("cell"))
    dealt = dealt.select(
        "h", "id", "component", "cell.i", "cell.j", (other & (F.col("cell.i") == F.col("x"))).alias("left"), (F.col("cell.j") == F.col("y")).alias("right")
    ).join(sets, "id")

    def links(group: pa.Table) -> pa.Table:
        return _links_of_blocks(group.filter(group["left"]), group.filter(group["right"]), percent)

    # Most groups have few sets, so what counts is the time for a group: Arrow takes a fraction of what pandas does.
    found = stage(dealt.groupBy("h", "i", "j").applyInArrow(links, "a bigint, b bigint").distinct(), "links-verified")
    drop(named, mixed)
    return found


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _count_pairs(common: np.ndarray, row: np.ndarray, starts: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> None:
    """Add to ``common`` each pair of a left and a right row that share an item."""
    k, m = common.shape
    flat, done = common.reshape(-1), 0
    ends = np.cumsum(lefts * rights)
    while done < len(starts):
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        start, n, width = starts[done:until], lefts[done:until], rights[done:until]
        left, width = row[_ranges(start, n)].astype("int64"), np.repeat(width, n)
        right = row[_ranges(np.repeat(start + n, n), width)] - k
        np.add.at(flat, np.repeat(left, width) * m + right, np.float32(1))
        done = until


def _links_of_blocks(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Components that similar sets connect, one set of each block: sizes of intersections by counted pairs and matrix products."""
    k, m = len(left), len(right)
    if not k or not m:
        return _pairs([])
    both = [t["items"].combine_chunks() for t in (left, right)]
    sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in both]).astype("int64")
    items = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in both])
    row = np.repeat(np.arange(k + m, dtype="int32"), sizes)
    order = np.argsort(items, kind="stable")
    items, row = items[order], row[order]
    # Runs of one item: the rows of the left block, then those of the right. Items of one side alone have no pair.
    starts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
    lefts = np.add.reduceat(row < k, starts, dtype="int64")
    rights = np.diff(starts, append=len(items)) - lefts
    del items, order
    common = np.zeros((k, m), "float32")
    few = np.flatnonzero((lefts > 0) & (rights > 0) & (lefts * rights <= FEW_PAIRS))
    _count_pairs(common, row, starts[few], lefts[few], rights[few])
    many = np.flatnonzero(lefts * rights > FEW_PAIRS)
    for at in range(0, len(many), COLUMNS):
        some = many[at : at + COLUMNS]
        part = np.zeros((k + m, len(some)), "float32")
        n = lefts[some] + rights[some]
        part[row[_ranges(starts[some], n)], np.repeat(np.arange(len(some)), n)] = 1
        common += part[:k] @ part[k:].T
    similar = np.zeros((k, m), bool)
    for at in range(0, k, ROWS):  # whole numbers, a few rows at a time
        n = common[at : at + ROWS].astype("int64")
        similar[at : at + ROWS] = 100 * n >= percent * (sizes[at : min(k, at + ROWS), None] + sizes[None, k:] - n)
    names, others = left["component"].to_numpy(), right["component"].to_numpy()
    similar &= names[:, None] != others[None, :]
    a, b = np.nonzero(similar)
    joined = np.unique(np.stack([names[a], others[b]], axis=1), axis=0)
    # A spanning forest of the components says as much as all links: fewer rows than there are sets.
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for x, y in joined.tolist():
        if top(x) != top(y):
            root[top(y)] = top(x)
            forest.append((x, y))
    return _pairs(forest)


def _pairs(rows: list[tuple[int, int]]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate("ab")})


def _verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar. Sizes come first: they alone rule out many."""
    sized = lookup(lookup(pairs, "a", sizes, "id").withColumnRenamed("n", "na"), "b", sizes, "id")
    near = stage(sized.filter(F.least("na", "n") * 100 >= F.greatest("na", "n") * percent), "pairs-sized")
    left = near.join(sets.select(F.col("id").alias("a"), F.col("items").alias("left")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("items").alias("right")), "b")
    common = both.select("a", "b", "na", "n", F.size(F.array_intersect("left", "right")).alias("common"))
    found = stage(common.filter(F.expr(f"100L * common >= {percent}L * (na + n - common)")).select("a", "b"), "links-verified")
    drop(near)
    return found


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after new links: components of the links between components."""
    if labels is None:
        return stage(components(links), "components")
    ends = _named(_named(links.withColumnRenamed("a", "id"), labels).select(F.col("component").alias("x"), F.col("b").alias("id")), labels)
    table = stage(components(ends.select(F.col("x").alias("a"), F.col("component").alias("b")).filter("a <> b")), "components-joined")
    joined = table.select(F.col("id").alias("old"), F.col("component").alias("new"))
    known = labels.join(joined.withColumnRenamed("old", "component"), "component", "left")
    known = known.select("id", F.coalesce("new", "component").alias("component"))
    fresh = joined.join(labels, F.col("old") == F.col("id"), "left_anti").select(F.col("old").alias("id"), F.col("new").alias("component"))
    merged = stage(known.unionByName(fresh), "components")
    drop(table)
    return merged
