"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows and ids, columns with clashing names."""

import random

from pyspark.sql import functions as F

EXTRA = "shard string, slot string, id string, part string, n string"


def words(rng, n, of="word"):
    return " ".join(f"{of}{rng.randrange(10**6)}" for _ in range(n))


def texts(seed=1):
    """(doc_id, text): near copies, exact copies, one text under two ids and two texts under one."""
    rng = random.Random(seed)
    base = words(rng, 60).split()
    rows = [(1, " ".join(base)), (2, " ".join([*base[:30], "changed", *base[31:]])), (3, " ".join(base)), (3, " ".join(base))]
    rows += [(4, None), (5, ""), (6, "  \n\t "), (None, words(rng, 30)), (None, None), (7, "two words"), (8, "Two  WORDS")]
    rows += [(9, words(rng, 12)), (9, words(rng, 14)), (10, words(rng, 20_000)), (11, "Ünïcödé ÇA 日本 ﬁ don't <|endoftext|> a_b 3½")]
    return rows


def frame(spark, rows, fields="doc_id bigint, text string"):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, fields)
    return df.select("*", *[F.lit("x").alias(f.split()[0]) for f in EXTRA.split(", ")])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clusters(n, linked):
    """Root of each of n things: the smallest it reaches."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]
