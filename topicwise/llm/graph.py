"""Connected components of links between ids (longs), as a loop of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwise.llm.common import drop, small, stage

#: Copies of a lookup row, so that the many links of one id are dealt to as many tasks.
SALTS = 16


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Join ``rows`` to the staged ``table``, whose ``table_key`` is unique: broadcast below a counted bound, else salted, as
    many rows may have one key. The key of ``table`` is dropped."""
    if small(table):
        return rows.join(F.broadcast(table.withColumnRenamed(table_key, "_k")), F.col(key) == F.col("_k")).drop("_k")
    copies = table.withColumnRenamed(table_key, "_k").withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(copies, (F.col(key) == F.col("_k")) & (F.col("_s") == F.col("_t"))).drop("_k", "_s", "_t")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id it reaches.

    Each round an id takes the smallest label next to it, then the label of its label, so paths shorten as they are walked.
    """
    links = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    table = labels
    while True:
        near = lookup(links, "b", labels, "id").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        stepped = stage(
            labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels-near"
        )
        of_label = stepped.select("id", F.col("label").alias("jump"))
        labels_now = stage(
            lookup(stepped, "label", of_label, "id").select("id", F.least("label", "jump").alias("label"), "was"), "labels"
        )
        drop(table, stepped)
        if not labels_now.filter("label <> was").limit(1).count():
            drop(links)
            return labels_now.select("id", F.col("label").alias("component"))
        table, labels = labels_now, labels_now.select("id", "label")
