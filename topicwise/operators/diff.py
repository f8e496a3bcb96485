"""Structural payload comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicwise.functions.payload import is_object, nesting_bound, same_value, strict_json
from topicwise.functions.text import dotted
from topicwise.session import prepare, staged

CHANGES = "array<struct<path:string,diff_type:string,old_value:string,new_value:string>>"


def _is_variant(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.VariantType)


def _as_variant(df: DataFrame, name: str) -> Column:
    """A JSON text parsed; a text that is not JSON as a string; a missing side as JSON null."""
    null = F.parse_json(F.lit("null"))
    if _is_variant(df, name):
        return F.coalesce(F.col(name), null)
    return F.coalesce(strict_json(name), F.col(name).cast("variant"), null)


#: Levels of two objects that one round compares in the row.
LEVELS = 4


def _by_depth(pairs: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that one round is sure to compare to the end, and the others: both sides have more brackets than it goes down."""
    prepare(pairs.sparkSession)
    sides = [F.to_json(n) if _is_variant(pairs, n) else F.col(n) for n in ("a", "b")]
    deep = F.least(*[nesting_bound(s) for s in sides]) > levels
    return pairs.filter(~deep), pairs.filter(deep)


def _first_round(pairs: DataFrame, pair_id: str, levels: int) -> DataFrame:
    """Each pair with ``changes``: its differences as an array of ``(path, diff_type, old_value, new_value)``.

    Both payloads sit in one row, so nothing is joined or shuffled. Objects that differ below ``levels`` are one entry of type
    ``deeper``.
    """
    x, y = F.col("x"), F.col("y")
    same_text = F.lit(False) if _is_variant(pairs, "a") or _is_variant(pairs, "b") else F.col("a").eqNullSafe(F.col("b"))
    sides = pairs.select(
        F.col(pair_id).alias(pair_id),
        _as_variant(pairs, "a").alias("x"),
        _as_variant(pairs, "b").alias("y"),
        same_text.alias("same_text"),
    )
    whole = F.array(_change(F.lit("value"), "modified", x, y))
    changes = (
        F.when(F.col("same_text"), _no_change())
        .when(is_object(x) & is_object(y), _changes_inside(x, y, F.lit(""), levels))
        .when(same_value(x, y), _no_change())
        .otherwise(whole)
    )
    return sides.select(pair_id, changes.alias("changes"))


def _numbered(compared: DataFrame) -> DataFrame:
    return staged(compared.withColumn("_row", F.monotonically_increasing_id()), "diff-round")


def _deeper(compared: DataFrame, levels: int) -> DataFrame | None:
    """``(_row, changes)`` of what the rounds after the first find; None where there is nothing deeper."""
    out = None
    while True:
        rest = compared.select("_row", F.explode(F.filter("changes", lambda c: c["diff_type"] == "deeper")).alias("c"))
        if rest.isEmpty():
            return out
        inside = _changes_inside(F.parse_json("c.old_value"), F.parse_json("c.new_value"), F.col("c.path"), levels)
        compared = staged(rest.select("_row", inside.alias("changes")), "diff-round")
        out = compared if out is None else out.unionByName(compared)


def _no_change() -> Column:
    return F.expr(f"cast(array() as {CHANGES})")


def _change(path: Column, kind: str, x: Column | None, y: Column | None) -> Column:
    missing = F.lit(None).cast("string")
    return F.struct(
        path.alias("path"),
        F.lit(kind).alias("diff_type"),
        (missing if x is None else F.to_json(x)).alias("old_value"),
        (missing if y is None else F.to_json(y)).alias("new_value"),
    )


def _changes_inside(x: Column, y: Column, prefix: Column, levels: int) -> Column:
    """Differences between the members of two objects."""
    xs, ys = x.try_cast("map<string,variant>"), y.try_cast("map<string,variant>")

    def pair_up(both: Column) -> Column:
        a, b = both["xs"], both["ys"]
        names = F.array_union(F.map_keys(a), F.map_keys(b))
        return F.transform(names, lambda k: F.struct(dotted(prefix, k).alias("path"), a[k].alias("x"), b[k].alias("y")))

    # Through an array of one, so that the objects are taken apart once and not again for every member.
    members = F.transform(F.array(F.struct(xs.alias("xs"), ys.alias("ys"))), pair_up)[0]

    def compare(m: Column) -> Column:
        old, new, path = m["x"], m["y"], m["path"]
        below = _changes_inside(old, new, path, levels - 1) if levels > 1 else F.array(_change(path, "deeper", old, new))
        # A JSON null is a value here; only a missing key gives NULL.
        return (
            F.when(new.isNull(), F.array(_change(path, "removed", old, None)))
            .when(old.isNull(), F.array(_change(path, "added", None, new)))
            .when(F.to_json(old) == F.to_json(new), _no_change())
            .when(is_object(old) & is_object(new), below)
            .when(same_value(old, new), _no_change())
            .otherwise(F.array(_change(path, "modified", old, new)))
        )

    return F.flatten(F.transform(members, compare))


def diff_payloads(pairs: DataFrame, pair_id: str = "pair_id", levels: int = LEVELS) -> DataFrame:
    """Differences of ``(pair_id, a, b)``: path, removed / added / modified, old and new value as JSON text.

    ``a`` and ``b`` are JSON texts or VARIANT. Objects are compared member by member to any depth, ``levels`` of them in a
    round, everything else as a whole; an added or removed subtree is one row. If a root is not an object the pair is one
    value at path ``value``. Only pairs that may be nested deeper are written to the shared folder on the way.
    """
    flat, deep = _by_depth(pairs, levels)
    # An inner generator would make Catalyst test the array for being empty first, and so compare everything twice.
    rows = _first_round(flat, pair_id, levels).select(pair_id, F.inline_outer("changes")).filter("diff_type IS NOT NULL")
    if deep.isEmpty():
        return rows
    compared = _numbered(_first_round(deep, pair_id, levels))
    rows = rows.unionByName(compared.select(pair_id, F.inline("changes")))
    below = _deeper(compared, levels)
    if below is not None:
        rows = rows.unionByName(below.join(compared.select("_row", pair_id), "_row").select(pair_id, F.inline("changes")))
    return rows.filter("diff_type <> 'deeper'")


def diff_summary(pairs: DataFrame, pair_id: str = "pair_id", levels: int = LEVELS) -> DataFrame:
    """Counts per pair, identical pairs included. Counted inside the row; only deep differences are joined to their pair."""
    kinds = ("added", "removed", "modified")

    def count_of(kind: str) -> Column:
        return F.size(F.filter("changes", lambda c: c["diff_type"] == kind)).cast("bigint")

    flat, deep = _by_depth(pairs, levels)
    counts = {kind: count_of(kind) for kind in kinds}
    rows = _first_round(flat, pair_id, levels).select(pair_id, *[c.alias(kind) for kind, c in counts.items()])
    if not deep.isEmpty():
        compared = _numbered(_first_round(deep, pair_id, levels))
        more = compared.select(pair_id, "_row", *[c.alias(kind) for kind, c in counts.items()])
        below = _deeper(compared, levels)
        if below is not None:
            added = below.groupBy("_row").agg(*[F.sum(c).alias(f"deep_{kind}") for kind, c in counts.items()])
            more = more.join(added, "_row", "left")
            more = more.withColumns({kind: F.col(kind) + F.coalesce(f"deep_{kind}", F.lit(0)) for kind in kinds})
        rows = rows.unionByName(more.select(pair_id, *kinds))
    return rows.select(
        pair_id,
        *[F.col(kind).alias(f"{kind}_count") for kind in kinds],
        (F.col("added") + F.col("removed") + F.col("modified") == 0).alias("identical"),
    )


def pair_records(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs for a comparison: records of two frames sharing the key columns, compared by payload or, without, value."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*on, F.coalesce(F.to_json("payload"), F.col("value")).alias(name))

    pairs = side(left, "a").join(side(right, "b"), on)
    return pairs.select(F.to_json(F.struct(*on)).alias("pair_id"), "a", "b")
