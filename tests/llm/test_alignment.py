"""Alignment of two tokenizers against a version that encodes whole texts and counts in one dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicwise.llm import alignment
from topicwise.llm.queries import tokenizer_path

from .helpers import frame, rows_of, texts

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


class Whole:
    """The contract's rules on whole texts."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        visible = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        hidden = [b for b in range(256) if b not in visible]
        self.byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def groups(self, text):
        ids_a = self.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = self.b.encode(text) if text else []
        part_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in ids_a]
        part_b = []
        for i in ids_b:
            p = self.b.id_to_piece(i)
            part_b.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        if not text or b"".join(part_a) != f" {text}".encode() or b"".join(part_b) != f" {text}".encode():
            return []
        ends_a, ends_b = np.cumsum([len(p) for p in part_a]), np.cumsum([len(p) for p in part_b])
        out, done_a, done_b = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            next_a, next_b = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            out.append((ids_a[done_a:next_a], ids_b[done_b:next_b]))
            done_a, done_b = next_a, next_b
        return out


def brute(rows):
    whole = Whole()
    groups = [whole.groups(t) for _, t in rows]
    links = [[(a, b) for ga, gb in g for a in ga for b in gb] for g in groups]
    counts = Counter(p for held in links for p in set(held))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), g, held in zip(rows, groups, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        n_best = sum(counts[p] == best[p[0]] for p in held)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(held), n_best, sum(counts[p] for p in held), digest))
    return sorted(out, key=repr)


ROWS = texts() + [
    (20, "  two  spaces\n\n and\n \tlines \n"), (21, " "), (22, "a "), (23, "a ▁ b"), (24, "don't <s> </s> <0x41> \x00 \x1c end"), (25, "\n"),
    (26, "日本語のテキスト " * 40), (27, "x" * 3000), (28, "naïve café 😀😀 Ελληνικά x y 　"), (29, "the the the the"), (29, "the the the the"), (30, "    \n    x"),
]


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(alignment, "BUCKET_PAIRS", 150)
    monkeypatch.setattr(alignment, "VECTOR_ROWS", 30)
    monkeypatch.setattr(alignment, "FAN_IN", 2)


def test_like_whole_texts(spark):
    assert rows_of(alignment.align(frame(spark, ROWS).repartition(3), *PATHS)) == brute(ROWS)


@pytest.mark.parametrize("local_pairs", [0, 40, 10**6])
def test_parts(spark, small_buckets, local_pairs):
    """Many buckets, vectors summed over several levels, and pairs counted by a join beyond what workers hold."""
    rows = [r for r in ROWS if len(r[1] or "") < 20_000] * 2
    found = alignment.align(frame(spark, rows).repartition(7), *PATHS, local_pairs=local_pairs, with_groups=True)
    assert rows_of(found.drop("groups")) == brute(rows)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in found.filter("groups <> ''").collect())


def test_texts_are_aligned_once(spark, tmp_path):
    """The second pass reads what the first wrote, not the texts."""
    frame(spark, ROWS).write.parquet(str(tmp_path / "docs"))
    found = alignment.align(spark.read.parquet(str(tmp_path / "docs")), *PATHS)
    assert rows_of(found) == brute(ROWS)
    assert found.inputFiles() and not any(str(tmp_path) in f for f in found.inputFiles())


def test_nothing(spark):
    assert alignment.align(frame(spark, []), *PATHS).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'sé. \n\t 　\x1c1日😀"), max_size=30))
def test_units(text):
    """What is put together from units equals what the tokenizers give for the whole text."""
    tool, whole = alignment.aligner(*PATHS), Whole.shared
    units = tool.units(text)
    tool.start(text)
    tool.learn([units], alignment.Links.groups)
    found = ";".join(tool.new[u] for u in units) if units and None not in [tool.new[u] for u in units] else ""
    assert found == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in whole.groups(text))


Whole.shared = Whole()


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**48), max_size=400))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    hashed = alignment.PerfectHash(*alignment.build_hash(keys))
    assert sorted(hashed(keys).tolist()) == list(range(len(keys)))
    other = hashed(np.array([random.getrandbits(50) for _ in range(100)], np.int64))
    assert ((other >= -1) & (other < max(len(keys), 1))).all()


def test_links_come_back_in_small_batches(spark, monkeypatch):
    """Both passes are written with a bound on the rows of a batch: 10,000 texts with their links would fill a task's memory."""
    bounds, staged = {}, alignment.stage
    monkeypatch.setattr(alignment, "stage", lambda df, name, *bound: bounds.update({name: bound}) or staged(df, name, *bound))
    assert alignment.align(spark.createDataFrame([(1, "some text"), (2, "some other text")], "doc_id long, text string"), *PATHS).count() == 2
    assert bounds["texts-aligned"] == bounds["aligned"] == (1000,)
