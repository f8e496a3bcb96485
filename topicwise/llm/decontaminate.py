"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

The index holds postings (term, document, position) of the corpus for the rarest term of every test phrase, each with the
words around it. A phrase lies where the offset-adjusted lists of all its terms meet; starting from the shortest list, that
of its rarest term, the words around a posting tell the other terms' positions, so no long list is ever read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwise.llm.common import BROADCAST_ROWS, ascii_lower, stage

#: Fixed value of the contract: what separates words, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def phrases(benchmark: DataFrame, size: int, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, words) of every item that has words; repeated rows once."""
    rows = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("words"))
    return rows.withColumn("n", F.size("words")).filter("n > 0").distinct()


def term_counts(docs: DataFrame, terms: DataFrame, *, text_col: str = "text") -> DataFrame:
    """How often each of ``terms`` (term, block) stands in the corpus, over all of it; absent terms count 0."""
    rows = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    found = _by_block(terms, lambda block: rows.join(F.broadcast(block.select("term")), "term").groupBy("term").agg(F.count("*").alias("n")))
    return terms.select("term").join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def _by_block(terms: DataFrame, function) -> DataFrame:
    """Union of ``function`` over blocks of terms that are small enough to broadcast; one block but for huge test sets."""
    blocks = terms.agg(F.max("block")).first()[0] or 0
    out = None
    for b in range(blocks + 1):
        part = function(terms.filter(F.col("block") == b))
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(terms: DataFrame) -> DataFrame:
    """Number the terms' blocks: as many as keep each within the broadcast bound on average, twice over for chance."""
    blocks = -(-2 * terms.count() // BROADCAST_ROWS)
    return terms.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(max(blocks, 1))).cast("int"))


def index(docs: DataFrame, terms: DataFrame, around: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of ``terms`` (term, block): (term, doc, text_hash, pos, left, right); ``left`` and ``right`` are up to
    ``around`` words before it, nearest first, and after it."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("words"))

    def postings(block: DataFrame) -> DataFrame:
        # The words stay in the row only through generation and join, where a row without a match is never built.
        each = rows.select("doc", "text_hash", "words", F.posexplode("words").alias("pos", "term"))
        hits = each.join(F.broadcast(block.select("term")), "term")
        before = F.greatest(F.col("pos") - around, F.lit(0))
        return hits.select(
            "term",
            "doc",
            "text_hash",
            F.col("pos").cast("int").alias("pos"),
            F.reverse(F.slice("words", before + 1, F.col("pos") - before)).alias("left"),
            F.slice("words", F.col("pos") + 2, F.lit(around)).alias("right"),
        )

    return _by_block(terms, postings)


def anchors(items: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Each phrase's rarest term, phrases of one item that share the place of it in one row.

    (term, item, n, at, first, last, left, right): phrases start at ``first`` to ``last``; ``left`` and ``right`` are the
    item's words around place ``at``, as in the index.
    """
    each = items.select("item", "words", "n", F.posexplode("words").alias("at", "term"))
    each = each.join(counts.withColumnRenamed("n", "count"), "term")
    by_item = each.groupBy("item", "words", "n").agg(F.array_sort(F.collect_list(F.struct("at", "count", "term"))).alias("terms"))
    width = F.least(F.lit(size), F.col("n"))
    starts = by_item.select("item", "words", "n", "terms", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("start"))
    rarest = F.array_min(F.transform(F.slice("terms", F.col("start") + 1, F.col("width")), lambda t: F.struct(t["count"], t["at"], t["term"])))
    chosen = starts.select("item", "words", "n", "width", "start", rarest.alias("r"))
    spans = chosen.groupBy("item", "words", "n", "width", F.col("r.at").alias("at"), F.col("r.term").alias("term")).agg(
        F.min("start").alias("first"), F.max("start").alias("last")
    )
    before = F.greatest(F.col("at") - (size - 1), F.lit(0))
    return spans.select(
        F.col("term"), "item", "width", "at", "first", "last",
        F.reverse(F.slice("words", before + 1, F.col("at") - before)).alias("item_left"),
        F.slice("words", F.col("at") + 2, F.lit(size - 1)).alias("item_right"),
    )


def _run(a: str, b: str) -> Column:
    """How many first elements two arrays share."""
    same = f"zip_with({a}, {b}, (x, y) -> coalesce(x = y, false))"
    return F.expr(f"coalesce(nullif(array_position({same}, false), 0) - 1, size({same}))")


def exact_matches(postings: DataFrame, anchored: DataFrame) -> DataFrame:
    """(doc, text_hash, item, begin, end): document word ranges covered by phrases of an item, ends included."""
    pairs = postings.join(anchored, "term")
    pairs = pairs.select(
        "doc", "text_hash", "item", "pos", "at", "first", "last", "width", _run("left", "item_left").alias("l"), _run("right", "item_right").alias("r")
    )
    # Phrases that lie within the run of equal words around the anchor.
    low, high = F.greatest("first", F.col("at") - F.col("l")), F.least("last", F.col("at") + F.col("r") + 1 - F.col("width"))
    shift = F.col("pos") - F.col("at")
    found = pairs.withColumns({"low": low, "high": high}).filter("low <= high")
    return found.select("doc", "text_hash", "item", (F.col("low") + shift).alias("begin"), (F.col("high") + shift + F.col("width") - 1).alias("end"))


def proximity_matches(postings: DataFrame, queries: DataFrame, near: int) -> DataFrame:
    """(query, doc, text_hash, pos): postings of a query's ``term`` with all its ``others`` at most ``near`` words away.

    ``queries`` is (query, term, others); give its rarest term as ``term``. ``near`` is at most what the index keeps around.
    """
    around = F.concat(F.slice("left", 1, near), F.slice("right", 1, near))
    pairs = postings.join(queries, "term")
    return pairs.filter(F.size(F.array_except("others", around)) == 0).select("query", "doc", "text_hash", "pos")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside occurrences of phrases of ``size`` words, or of a whole
    shorter item), items (ids of the items found, as sorted strings), text_hash.

    Null and empty texts have no words. Repeated rows get the same result each; null ids are documents like others. An item
    with a null id marks words, but is not listed. Without items nothing is hit. Other columns are ignored.
    """
    items = stage(phrases(benchmark, size, id_col=item_col, text_col=item_text_col), "items")
    terms = stage(_blocks(items.select(F.explode("words").alias("term")).distinct()), "terms")
    counts = stage(term_counts(docs, terms, text_col=text_col), "term-counts")
    anchored = stage(anchors(items, counts, size), "anchors")
    rare = stage(_blocks(anchored.select("term").distinct()), "rare-terms")
    postings = stage(index(docs, rare, size - 1, id_col=id_col, text_col=text_col), "postings")
    matches = stage(exact_matches(postings, anchored), "matches").distinct()

    # Union of ranges: each adds what reaches beyond all before it.
    before = "PARTITION BY doc, text_hash ORDER BY begin, end, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ranges = matches.withColumn("reach", F.expr(f"max(end) OVER ({before})"))
    added = F.greatest(F.col("end") - F.greatest(F.col("begin") - 1, F.coalesce("reach", F.lit(-1))), F.lit(0))
    found = ranges.groupBy("doc", F.col("text_hash").alias("h")).agg(
        F.sum(added).alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
    )
    all_docs = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.size(words(F.col(text_col))).cast("long").alias("n_words")
    )
    key = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("h"))
    return all_docs.join(found, key, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "text_hash",
    )
