"""License scans against a version that compares every block with every template."""

import math
import random
import re

import duckdb
import pytest

from topicwise.llm import licences
from topicwise.llm.queries import ORACLE

from .helpers import frame, rows_of, texts


def cut(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text, templates):
    w, places, base, labels, score = cut(text), [], set(), set(), 0.0
    for label, phrase, share, whole in templates:
        p = cut(phrase)
        need = max(math.ceil(share * len(set(p)) - 1e-9), 1)
        for b in range(0, len(w), len(p)) if p else ():
            held = len(set(w[b : b + 2 * len(p) - 1]) & set(p))
            runs = [i for i in range(b, b + len(p)) if w[i : i + len(p)] == p]
            if held >= need and (runs or not whole):
                labels.add(label)
                score = max(score, held / len(set(p)))
                if whole:
                    base.add(label)
                    places += runs
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), score


def licensed(seed=3):
    """Phrases across line ends, notices with words lost and words between, at the start, the end and in very long texts."""
    rng, rows = random.Random(seed), []
    notices = [t for _, t in licences.PHRASES + licences.NOTICES]
    for i in range(60):
        notice = rng.choice(notices).split()
        kept = [x for x in notice if rng.random() > rng.choice((0, 0.1, 0.3))]
        filler = [rng.choice(("the", "of", "license", "public", "word", "cc", "by")) for _ in range(rng.randrange(40))]
        rows.append((100 + i, rng.choice((" ", "\n", ", ")).join(filler + kept).upper() + (" tail" if i % 2 else "")))
    return rows + [(1, "mit license mit license MIT-License"), (2, "license mit"), (3, "x " * 30_000 + "CC-BY 4.0"), (4, "MIT"), (5, "GNU General\nPublic  License")]


@pytest.fixture(scope="module")
def listed():
    return [(*p, 1.0, True) for p in licences.PHRASES] + [(*n, licences.CONTAINMENT, False) for n in licences.NOTICES]


def test_like_brute_force(spark, listed):
    rows = texts() + licensed()
    found = licences.scan(frame(spark, rows), licences.templates(spark)).drop("text_hash")
    expected = sorted(((i, *brute(t, listed)) for i, t in rows), key=repr)
    assert rows_of(found) == expected
    assert sum(r[2] for r in expected) > 20 and sum(len(r[6]) > len(r[5]) for r in expected) > 10


def test_other_templates(spark):
    own = [("a", "one two three four five", 0.6, False), ("b", "two two", 1.0, True), ("c", "", 0.5, False), ("d", "rare", 1.0, True)]
    rows = [(1, "five x one y three"), (2, "two two two"), (3, "one"), (None, "rare rare"), (None, "rare rare"), (4, "")]
    wanted = spark.createDataFrame([(i, *t) for i, t in enumerate(own)], "template int, label string, text string, containment double, whole boolean")
    assert rows_of(licences.scan(frame(spark, rows), wanted).drop("text_hash")) == sorted(((i, *brute(t, own)) for i, t in rows), key=repr)
    assert [r.score for r in licences.scan(frame(spark, rows), wanted.limit(0)).collect()] == [0.0] * 6


def test_nothing(spark):
    assert licences.scan(frame(spark, []), licences.templates(spark)).collect() == []


def test_sql(listed):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [r for r in licensed() if r[0] != 3] + [(300, None), (301, "")]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score FROM ({ORACLE['op11_license_containment']})").fetchall()
    expected = [(i, *r[:4], ",".join(r[4]), ",".join(r[5]), r[6]) for i, r in ((i, brute(t, listed)) for i, t in rows)]
    assert sorted(found) == sorted(expected)
