"""Projections that show records: table, raw line, dead-letter list, inspection, hops, payload tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwise.functions.payload import kind_of, nesting_bound, payload_text
from topicwise.functions.text import dotted, ellipsis, non_empty
from topicwise.session import prepare, staged


def _or_dash(c: Column | str) -> Column:
    return F.coalesce(non_empty(c), F.lit("-"))


def summary_view(df: DataFrame) -> DataFrame:
    """The nine fields of a record summary. ``payload`` is JSON text; an empty or absent payload shows the value."""
    text = F.to_json("payload")
    return df.select(
        "topic",
        "partition",
        "offset",
        F.col("timestamp_ms").alias("timestamp"),
        "key",
        F.col("payload_format").alias("format"),
        "is_dlq",
        "headers",
        F.coalesce(F.when(~text.isin("{}", "[]"), text), F.col("value")).alias("payload"),
    )


def table_view(df: DataFrame, width: int = 60) -> DataFrame:
    """One line per record with a cut preview (60 characters on the console, 40 on the full screen)."""
    ts = F.when(F.col("timestamp_ms") != 0, F.col("timestamp_ms").cast("string"))
    return df.select(
        F.when(F.col("is_dlq"), "DLQ").otherwise("OK").alias("status"),
        "partition",
        "offset",
        _or_dash("key").alias("key"),
        F.col("payload_format").alias("format"),
        ellipsis(F.coalesce(payload_text(), F.lit("")), width).alias("preview"),
        F.coalesce(ts, F.lit("-")).alias("timestamp"),
    )


def raw_view(df: DataFrame) -> DataFrame:
    """``[partition:offset] value``; a missing value reads None."""
    line = F.concat(
        F.lit("["),
        F.col("partition").cast("string"),
        F.lit(":"),
        F.col("offset").cast("string"),
        F.lit("] "),
        F.coalesce("value", F.lit("None")),
    )
    return df.select(line.alias("line"))


def dlq_list_view(df: DataFrame) -> DataFrame:
    """Offset, key and shortened error of each dead letter."""
    error = F.coalesce(non_empty("error_message"), F.lit("Unknown failure"))
    return df.select("offset", _or_dash("key").alias("key"), ellipsis(error, 30).alias("error"))


def inspect_view(diagnosed: DataFrame) -> DataFrame:
    """Coordinates, diagnosis, headers (one ``name: value`` line each, by name) and payload of dead letters."""
    lines = F.transform(
        F.array_sort(F.map_entries("headers")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])
    )
    return diagnosed.select(
        "topic",
        "partition",
        "offset",
        "key",
        "failure_category",
        "root_cause",
        "suggested_action",
        F.array_join(lines, "\n").alias("headers_text"),
        payload_text().alias("payload_text"),
    )


def hop_view(hops: DataFrame) -> DataFrame:
    """Printable trace lines from the output of ``trace_hops``."""
    event = F.coalesce(non_empty("event_type"), non_empty(F.substring("error_message", 1, 20)), F.lit("Message"))
    delta = F.concat(F.lit("+"), F.round("latency_ms").cast("bigint").cast("string"), F.lit(" ms"))
    return hops.select(
        "correlation_id",
        "step",
        "topic",
        F.concat_ws(":", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("position"),
        event.alias("event"),
        F.coalesce(delta, F.lit("START")).alias("delta"),
        F.when(F.col("is_dlq"), "POISON (DLQ)").otherwise("SUCCESS").alias("status"),
    )


#: Levels of a payload that one round takes apart in the row.
LEVELS = 6


def flatten_payload(df: DataFrame, *, keep: tuple[str, ...] = ("topic", "partition", "offset"), levels: int = LEVELS) -> DataFrame:
    """Every node below the payload root: ``path``, ``node_type`` (object, array, leaf) and the leaf's text.

    Payloads may be nested to any depth. A round walks ``levels`` levels in one expression and shuffles nothing; subtrees that
    go deeper are the next round's input, until none is left. Payloads with no more brackets than one round walks down are
    walked as they are read. Others are written to the shared folder between rounds, as the next one has to know whether
    anything is left.
    """
    prepare(df.sparkSession)
    found = df.filter(F.col("payload").isNotNull()).select(*keep, F.lit("").alias("_path"), F.col("payload").alias("_tree"))
    deep = nesting_bound(F.to_json("_tree")) > levels
    done = _walked(found.filter(~deep), keep, levels).drop("_rest")
    found = found.filter(deep)
    while not found.isEmpty():
        nodes = staged(_walked(found, keep, levels), "payload-nodes")
        done = done.unionByName(nodes.drop("_rest"))
        rest = nodes.filter("_rest IS NOT NULL")
        found = rest.select(*keep, F.col("path").alias("_path"), F.parse_json("_rest").alias("_tree"))
    return done


def _walked(trees: DataFrame, keep: tuple[str, ...], levels: int) -> DataFrame:
    """Nodes of ``_tree`` down to ``levels``; ``_rest`` is the JSON text of one that has more below."""
    # An inner generator would make Catalyst test the array for being empty first, and so walk everything twice.
    nodes = trees.select(*keep, F.inline_outer(_nodes_below(F.col("_tree"), F.col("_path"), 1, levels)))
    nodes = nodes.filter(F.col("level").isNotNull()).withColumn("_kind", kind_of("v"))
    kind = (
        F.when(F.startswith("_kind", F.lit("OBJECT<")), "object")
        .when(F.startswith("_kind", F.lit("ARRAY<")), "array")
        .otherwise("leaf")
    )
    deeper = (F.col("level") == levels) & (kind != "leaf") & ~F.to_json("v").isin("{}", "[]")
    return nodes.select(
        *keep,
        "path",
        kind.alias("node_type"),
        F.when(kind == "leaf", F.try_variant_get("v", "$", "string")).alias("leaf_text"),
        F.when(deeper, F.to_json("v")).alias("_rest"),
    )


def _nodes_below(v: Column, path: Column, level: int, max_depth: int) -> Column:
    def node(at: Column, value: Column) -> Column:
        return F.struct(at.alias("path"), value.alias("v"), F.lit(level).alias("level"))

    members = F.transform(
        F.map_entries(v.try_cast("map<string,variant>")), lambda e: node(dotted(path, e["key"]), e["value"])
    )
    items = F.transform(
        v.try_cast("array<variant>"), lambda x, i: node(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x)
    )
    children = F.coalesce(members, items, F.expr("cast(array() as array<struct<path:string,v:variant,level:int>>)"))
    if level == max_depth:
        return children
    return F.flatten(
        F.transform(children, lambda c: F.concat(F.array(c), _nodes_below(c["v"], c["path"], level + 1, max_depth)))
    )
