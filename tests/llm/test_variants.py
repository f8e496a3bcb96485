"""Spelling variants against a version that compares every two words."""

import random
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicwise.llm import variants
from topicwise.llm.queries import ORACLE

from .helpers import EXTRA, frame, rows_of
from pyspark.sql import functions as F


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + (len(a) > len(b)) :] == b[k + (len(b) > len(a)) :]


def brute(counts, ratio=5):
    out, form = [], {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out.append([w, n, len(near), form[w], counts[form[w]] if form[w] else None])
    for row in out:
        root = row[0]
        while form[root]:
            root = form[root]
        row.append(root)
    return sorted(map(tuple, out), key=repr)


def family(seed, size, alphabet="abcé"):
    """Words that share much: of one stem, with letters lost, added and changed everywhere."""
    rng, out = random.Random(seed), {}
    stem = "".join(rng.choice(alphabet) for _ in range(9))
    while len(out) < size:
        w = list(stem[: rng.randrange(1, 10)] if rng.random() < 0.2 else stem)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", rng.choice(alphabet)])
        if w:
            out["".join(w)] = rng.choice((1, 2, 5, 10, 25, 125, 700))
    return out


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", min_size=0, max_size=7), max_size=25))
def test_list_scan(words):
    for order in (sorted(words), list(words)):
        found = list(variants.one_edit(order))
        assert sorted(found) == [(i, j) for i in range(len(order)) for j in range(i + 1, len(order)) if one_edit(order[i], order[j])]


@pytest.mark.parametrize("group_words", [2, 7, 1000])
def test_like_brute_force(spark, group_words):
    """Also with groups so small that they are dealt again and again; no pair is lost or found twice."""
    counts = family(1, 150) | {"z" * 3000: 9, "z" * 2999: 100, "y": 1, "x": 5}
    rows = [(w, n) for w, n in counts.items()] + [(None, 3), ("", 8), ("nocount", None)]
    words = spark.createDataFrame(rows, "word string, n bigint").select("*", *[F.lit("x").alias(f.split()[0]) for f in EXTRA.split(", ") if f.split()[0] != "n"])
    found = variants.variants(words, group_words=group_words).select("word", "n", "n_near", "form", "form_n", "root")
    assert rows_of(found) == brute(counts)


def test_texts(spark):
    rows = [(1, "Colour, color COLOR\ncolor"), (2, None), (3, ""), (None, "Été été ÉTÉ"), (4, "co1or a"), (4, "co1or a"), (5, "x" * 50_000)]
    runs = variants.runs(frame(spark, rows), at_least=2)
    assert Counter(r.run for r in runs.collect()) == {"colour": 1, "color": 3, "Été": 1, "été": 1, "ÉtÉ": 1, "co": 2, "or": 2, "x" * 50_000: 1}
    words = runs.select(F.col("run").alias("word"))
    assert rows_of(variants.vocabulary(words, at_least=2, min_length=3)) == [("color", 3)]
    assert variants.variants(variants.vocabulary(words, 100, 1)).collect() == []


def test_sql():
    """The SQL on words that its own deletion rule changes, against plain Python."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("straßen", "strassen", "strasse", "Strasser", "señora", "señoras")) for _ in range(40))) for i in range(60)]
    counts = Counter()
    for i, text in rows:
        for w in text.replace("S", "s").split():
            h = zlib.crc32(f"{i}:{w}".encode())
            counts[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    assert len(counts) > 6
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(f"SELECT word, n, n_near, form, form_n, root FROM ({ORACLE['op12_spelling_sorted_list']})").fetchall()
    assert sorted(found, key=repr) == brute({w: n for w, n in counts.items() if n >= 5 and len(w) >= 6})
