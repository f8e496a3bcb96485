"""Near-duplicates of texts, paragraphs and vectors against all pairs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from topicwise.llm import lattice, minhash, paragraphs, similar as blocks
from topicwise.llm.graph import components

from .helpers import clusters, frame, texts, words


def similar(a, b, percent=80):
    common = len(a & b)
    return bool(a and b) and 100 * common >= percent * (len(a) + len(b) - common)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    both = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    root = clusters(400, lambda i, j: (i, j) in both)
    assert found == {i: root[i] for e in edges for i in e}


def test_minhash(spark):
    rng = random.Random(3)
    rows = texts()
    base = words(rng, 80).split()
    for k in range(12):  # a chain: each near the one before, the ends far apart
        base[(5 * k) % 80] = f"new{k}"
        rows.append((50 + k, " ".join(base)))
    out = minhash.near_duplicates(frame(spark, rows), words=4).collect()
    assert len(out) == len(rows)
    sets = [set(minhash.shingles(t, 4).tolist()) for _, t in rows]
    root = clusters(len(rows), lambda i, j: similar(sets[i], sets[j]))
    expected = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        head = min(ids) if ids and sets[i] else doc
        expected.append((doc, len(sets[i]), head, doc == head))
    assert sorted(map(repr, expected)) == sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in out)


def test_minhash_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_paragraphs(spark):
    rng = random.Random(5)
    passage = words(rng, 55).split()
    other = [*passage[:20], "swapped", *passage[21:]]
    rows = [(i, f"{words(rng, 30)}\n{' '.join(passage)}\n{words(rng, 5)}") for i in range(1, 5)]
    rows += [(8, " ".join(other)), (9, f"{' '.join(passage)}\n{' '.join(passage)}"), (10, words(rng, 40)), *texts()[4:7], (None, " ".join(passage))]
    rows += [(10, rows[6][1])]  # the same row again is the same document
    docs = frame(spark, rows)
    found = paragraphs.repeated_paragraphs(docs)
    got = {(r["doc"], r["place"]): (r["cluster_doc"], r["kept"]) for r in found.collect()}
    places = [(1, 1), (2, 1), (3, 1), (4, 1), (8, 0), (9, 0), (9, 1), (None, 0)]
    assert got == {p: (1, p == (1, 1)) for p in places}
    kept = paragraphs.without_repeats(docs, found)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    after = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert after[1] == rows[0][1] and after[8] == "" and after[9] == "" and after[4] is None and after[10] == rows[6][1]
    assert after[2] == "\n".join(rows[1][1].split("\n")[::2])

def test_passages(spark):
    rng = random.Random(15)
    one, two, near = (words(rng, n).split() for n in (60, 70, 49))
    join = " ".join
    rows = [
        (1, f"{words(rng, 90)} {join(one)} {words(rng, 80)}"),  # inside a longer line
        (2, f"{words(rng, 200)} {join(one).upper()} {words(rng, 100)}"),
        (3, f"{words(rng, 100)} {join(two[:35])}\n{join(two[35:])} {words(rng, 100)}"),  # across a line end
        (4, f"{words(rng, 150)} {join(two[:30])}  {join(two[30:])} {words(rng, 60)}\n{words(rng, 3)}"),
        (5, "\n".join(join(one[i : i + 6]) for i in range(0, 60, 6)) + "\n" + words(rng, 30)),  # of short lines
        (6, f"{words(rng, 60)} {join(near)} {words(rng, 60)}"),  # a word short
        (7, f"{words(rng, 60)} {join(near)} {words(rng, 60)}"),
        (8, f"{join(two)} {words(rng, 9)} {join(two)} {join(one[:55])}"),
        (9, "the " * 300),  # repeats itself with overlaps
        (None, f"{words(rng, 30)} {join(two[5:])} x"),
        *texts()[4:7],
    ]
    rows += [rows[1]]  # the same row again is the same document
    docs = frame(spark, rows)
    found = paragraphs.repeated_paragraphs(docs)
    after = sorted(((r["doc_id"], (r["text"] or "").lower().split()) for r in paragraphs.without_repeats(docs, found).collect()), key=repr)

    seen, expected = {}, {}
    for i, (doc, text) in enumerate(rows[:10]):
        have = (text or "").lower().split()
        gone = set()
        for p in range(len(have) - 49):
            of, q = seen.setdefault(tuple(have[p : p + 50]), (i, p))
            if of != i or p >= q + 50:
                gone.update(range(p, p + 50))
        expected[i] = (doc, [w for p, w in enumerate(have) if p not in gone])
    expected = [*expected.values(), expected[1], *((doc, []) for doc, _ in texts()[4:7])]
    assert after == sorted(expected, key=repr)
    kept = {(r["doc"], r["cluster_doc"]) for r in found.filter("kept").collect()}
    assert kept == {(1, 1), (3, 3), (9, 9)}


def test_vectors(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(4, 64))
    vectors = [(i, (centre[i % 4] + 0.3 * rng.normal(size=64)).tolist()) for i in range(40)]
    vectors += [(100 + i, rng.normal(size=64).tolist()) for i in range(30)]
    vectors += [(200, [0.0] * 64), (201, None), (202, [float("nan")] * 64), (203, [1.0, None]), (204, []), (205, [1e-300, 2e-300]), (206, [1e300, 2e300])]
    vectors += [(207, vectors[0][1]), (207, vectors[0][1]), (None, rng.normal(size=64).tolist())]
    rows = frame(spark, vectors, "vec_id bigint, embedding array<double>")
    out = lattice.near_duplicates(rows).collect()

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.max(np.abs(v))
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in vectors]
    linked = lambda i, j: units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9
    root = clusters(len(vectors), linked)
    expected = []
    for i, (vec, _) in enumerate(vectors):
        ids = [vectors[j][0] for j in range(len(vectors)) if root[j] == root[i] and vectors[j][0] is not None]
        head = min(ids) if ids else None
        expected.append((vec, sum(bool(linked(i, j)) for j in range(len(vectors)) if j != i), head, vec == head))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in out)


def test_lattice_points():
    """The nearest point against all points of the lattice nearby."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 8)) * 0.6
    points, costs = lattice.nearest(x)
    assert (points.sum(axis=2) % 4 == 0).all()
    grid = np.stack(np.meshgrid(*[[-1, 0, 1]] * 8, indexing="ij"), axis=-1).reshape(-1, 8)
    whole = grid[grid.sum(axis=1) % 2 == 0]
    halves = np.stack(np.meshgrid(*[[-1.5, -0.5, 0.5, 1.5]] * 8, indexing="ij"), axis=-1).reshape(-1, 8)
    halves = halves[np.rint(halves.sum(axis=1)) % 2 == 0]
    for row, cost in zip(np.clip(x, -1, 1), lattice.nearest(np.clip(x, -1, 1))[1]):
        best = min(((whole - row) ** 2).sum(axis=1).min(), ((halves - row) ** 2).sum(axis=1).min())
        assert abs(best - cost[0]) < 1e-9


def test_recall_at_the_limit():
    """Pairs at a cosine of exactly 0.9 meet in a cell; strangers do not."""
    rng = np.random.default_rng(2)
    u = rng.normal(size=(600, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.normal(size=(600, 64))
    w -= (w * u).sum(axis=1)[:, None] * u
    v = 0.9 * u + np.sqrt(1 - 0.81) * w / np.linalg.norm(w, axis=1)[:, None]
    own = lattice.Lattice(24, 3, 3.4, 11, 3)
    a, b = own.cells(u), own.cells(v)
    met = lambda x, y: ((x[:, :, :1] == y).any(axis=(1, 2)) | (y[:, :, :1] == x).any(axis=(1, 2))).mean()
    assert met(a, b) > 0.99 and met(a, np.roll(b, 1, axis=0)) < 0.01


def test_lines_are_hashed_together(monkeypatch):
    """The same sets, digests and keys as line by line, without a call for each."""
    rng = random.Random(8)
    lines = [words(rng, n) for n in (1, 2, 4, 5, 6, 40, 3000)] + ["a b a b a b a b a b", "É ü\x0bB\t日本  x ", "X " * 30]
    hashes = minhash.Hashes(7, 4, 23)
    items, starts = minhash.shingles_of_lines(lines, 5)
    sets = [minhash.shingles(line, 5) for line in lines]
    assert [x.tolist() for x in np.split(items, starts[1:])] == [x.tolist() for x in sets]
    assert minhash.digests(items, starts).tolist() == [list(minhash.digest(x)) for x in sets]
    assert hashes.keys_of(items, starts).tolist() == [hashes.keys(x).ravel().tolist() for x in sets]

    class Source:
        def mapInArrow(self, run, fields):
            return run

    monkeypatch.setattr(paragraphs, "shingles", None)  # not called
    monkeypatch.setattr(paragraphs, "SLICE_CHARS", 30_000)  # reached with the last text that has lines
    fields = {"doc": [1, 2, 3], "text": ["\n".join(lines), None, ""], "text_hash": [7, 8, 9]}
    batch = pa.RecordBatch.from_pydict(fields)
    nothing = batch.slice(1)
    out = pa.Table.from_batches(paragraphs._lines(Source(), 5, 5, hashes, "bigint")(iter([nothing, batch]))).to_pylist()
    assert [(r["doc"], r["length"], r["k1"]) for r in out] == [(1, len(x), minhash.digest(minhash.shingles(x, 5))[0]) for x in lines if len(x.split()) >= 5]


def test_spans_and_powers():
    for text in ("", " ", "a", " a  b\n\nc\r\n", "é\xa0x\x1c y\x0b日本\n𝒳 z"):
        begins, ends, breaks = paragraphs._spans(text)
        assert list(zip(begins, ends)) == [m.span() for m in paragraphs.WORD.finditer(text)]
        assert breaks.tolist() == [i for i, c in enumerate(text) if c == "\n"]
    codes = np.random.default_rng(5).integers(0, 1 << 63, paragraphs.KEPT_POWERS + 9, "uint64")
    at = np.array([0, 5, len(codes) - 4])
    short = [paragraphs._runs(codes[i : i + 4], np.zeros(1, "int64"), 4, paragraphs.BASES[0])[0] for i in at]
    assert paragraphs._runs(codes, at, 4, paragraphs.BASES[0]).tolist() == short


@pytest.mark.parametrize("few", [0, 3, 10**6])
def test_blocks_against_all_pairs(monkeypatch, few):
    monkeypatch.setattr(blocks, "FEW_PAIRS", few)
    monkeypatch.setattr(blocks, "COLUMNS", 5)
    monkeypatch.setattr(blocks, "PAIRS", 20)
    rng = random.Random(9)
    base = [rng.sample(range(1000), 12) for _ in range(6)]
    sets = [sorted({*rng.choice(base)[: rng.randint(9, 12)], *rng.sample(range(1000), rng.randint(0, 2))}) for _ in range(60)]
    sides = pa.table({"items": pa.array(sets, pa.list_(pa.int64())), "component": range(60)})
    left, right = sides.slice(0, 25), sides.slice(20)
    found = [tuple(r.values()) for r in blocks._links_of_blocks(left, right, 80).to_pylist()]
    linked = {(i, j) for i in range(25) for j in range(20, 60) if i != j and similar(set(sets[i]), set(sets[j]))}
    assert linked and {*found} <= linked
    both = lambda pairs: clusters(60, lambda i, j: (i, j) in pairs or (j, i) in pairs)
    assert both({*found}) == both(linked)


def test_memory_of_blocks():
    """Items of one set alone take no column of a matrix, which had 4,096 of them for each set."""
    rng = np.random.default_rng(0)
    left, right = (pa.table({"items": [rng.integers(0, 1 << 40, 200) for _ in range(1000)], "component": range(1000)}) for _ in range(2))
    tracemalloc.start()
    assert not len(blocks._links_of_blocks(left, right, 80))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # 82 MB before
