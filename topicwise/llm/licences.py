"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A template is a set of words and a share of them that a block must contain. Words are put in one global order, rarest in the
corpus first. A block can only reach the share of a template of ``n`` words, ``need`` of them, if it holds one of the
template's first ``n - need + 1`` words in that order (prefix filter), has ``need`` template words at all (length filter) and
enough of them from the first shared word on (positional filter). So the corpus's words are looked up in a small table of
prefix words, and only blocks that pass the filters are compared.

Blocks of a template with ``w`` words: block k is words k*w to k*w + 2w - 2 of the text, so each run of ``w`` words lies whole in
exactly one block that it starts in, whatever lines it crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwise.llm.common import BROADCAST_ROWS, small, stage
from topicwise.llm.decontaminate import words

# Fixed values of the contract: the base phrases, all words of which must stand in a row.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Wording of public license notices.
NOTICES = (
    ("apache", "licensed under the apache license version 2.0 you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINMENT = 0.8
TEMPLATE = "template: int, label: string, text: string, containment: double, whole: boolean"


def templates(spark: SparkSession, containment: float = CONTAINMENT) -> DataFrame:
    """The templates (template, label, text, containment, whole): ``whole`` ones count only where their words stand in a row."""
    rows = [(label, text, 1.0, True) for label, text in PHRASES] + [(label, text, containment, False) for label, text in NOTICES]
    each = [F.struct(F.lit(i), *map(F.lit, row)).cast(f"struct<{TEMPLATE}>") for i, row in enumerate(rows)]
    return spark.range(1).select(F.inline(F.array(*each)))


def word_order(docs: DataFrame, wanted: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(term, rank) of the templates' words, rarest in the whole corpus first, words that it lacks before all; ranks from 0."""
    terms = wanted.select(F.explode(words(F.col("text"))).alias("term")).distinct()
    rows = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    counts = rows.join(_side(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ordered = terms.join(counts, "term", "left").select(F.coalesce("n", F.lit(0)).alias("n"), "term")
    # One row with all terms: the templates' words are far fewer than a broadcast table's rows, which is checked.
    return ordered.agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("t")).select(F.posexplode("t").alias("rank", "t")).select("t.term", "rank")


def _side(terms: DataFrame) -> DataFrame:
    if not small(terms):
        raise ValueError(f"templates have more than {BROADCAST_ROWS} different words; scan in several runs")
    return F.broadcast(terms)


def prefixes(wanted: DataFrame, order: DataFrame) -> DataFrame:
    """One row per prefix word of each template: (term, left, template, label, whole, phrase, width, need, tokens); ``tokens`` are
    the template's words in the global order, ``left`` of them from this one on. A template without words has none."""
    phrase = words(F.col("text"))
    each = wanted.select("template", "label", "whole", "containment", phrase.alias("phrase"), F.explode(F.array_distinct(phrase)).alias("term"))
    sets = each.join(order, "term").groupBy("template", "label", "whole", "containment", "phrase").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")
    )
    need = F.greatest(F.ceil(F.col("containment") * F.size("t") - F.lit(1e-9)), F.lit(1)).cast("int")
    sets = sets.select("template", "label", "whole", "phrase", F.size("phrase").alias("width"), need.alias("need"), F.transform("t", lambda x: x["term"]).alias("tokens"))
    each = sets.select("*", F.posexplode("tokens").alias("at", "term"))
    return each.withColumn("left", F.size("tokens") - F.col("at")).filter("left >= need").drop("at")


def blocks(docs: DataFrame, wanted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every block that holds the wanted share of a template's words.

    (doc, text_hash, template, label, whole, block, share, places): ``share`` is the share of the template's different words
    that the block holds, ``places`` the positions in the text where the template's words start to stand in a row. Of a
    ``whole`` template only blocks with such places are returned. Repeated rows (same id and text) give their blocks once each.
    """
    wanted = stage(wanted, "templates")
    order = stage(word_order(docs, wanted, text_col=text_col), "word-order")
    entries = stage(prefixes(wanted, order), "prefixes")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("words"))
    # The words stay in the row only through generation and join: a row without a prefix word is never built.
    hits = rows.select("doc", "text_hash", "words", F.posexplode("words").alias("pos", "term")).join(_side(entries), "term")
    own = F.expr("CAST(pos DIV width AS INT)")
    near = F.when(F.col("pos") % F.col("width") == F.col("width") - 1, F.array(own)).otherwise(F.array(own, own - 1))
    met = hits.select("*", F.explode(near).alias("block")).filter("block >= 0")
    met = met.withColumn("held", F.slice("words", F.col("block") * F.col("width") + 1, 2 * F.col("width") - 1))
    # Length and position: a block whose first shared word this is shares no more than either side has left.
    met = met.filter(F.least("left", F.size("held")) >= F.col("need"))
    met = met.withColumn("shared", F.array_intersect("tokens", "held")).filter(F.size("shared") >= F.col("need"))
    first = F.element_at("shared", 1) == F.col("term")  # its first shared word alone brings a block here,
    once = F.array_position("held", F.col("term")) == F.col("pos") - F.col("block") * F.col("width") + 1  # by its first place
    found = met.filter(first & once).select(
        "doc", "text_hash", "template", "label", "whole", "block",
        (F.size("shared") / F.size("tokens")).alias("share"),
        F.expr("filter(transform(sequence(0, width - 1), i -> block * width + i), p -> slice(words, p + 1, width) = phrase)").alias("places"),
    )
    return found.filter(~F.col("whole") | (F.size("places") > 0))


def scan(docs: DataFrame, wanted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of ``whole`` templates), first_word, last_word (smallest and largest
    of these places, from 0), base_labels, labels (sorted arrays), score (largest share of a template that a block holds, 0
    without any), text_hash.

    Null and empty texts have no words and no labels. Repeated rows get the same result each; null ids are documents like
    others. Without templates nothing is found. Other columns are ignored.
    """
    found = blocks(docs, wanted, id_col=id_col, text_col=text_col)
    found = found.groupBy("doc", "text_hash", "template", "label", "whole", "block").agg(
        F.first("share").alias("share"), F.first("places").alias("places")
    )
    base = F.when(F.col("whole"), F.col("places"))
    per = found.groupBy("doc", F.col("text_hash").alias("h")).agg(
        F.sum(F.coalesce(F.size(base), F.lit(0))).alias("n_base"),
        F.min(F.array_min(base)).alias("first_word"),
        F.max(F.array_max(base)).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    per = stage(per, "license-labels")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.size(words(F.col(text_col))).cast("long").alias("n_words")
    )
    key = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("h"))
    none = F.array().cast("array<string>")
    return rows.join(F.broadcast(per) if small(per) else per, key, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "text_hash",
    )
