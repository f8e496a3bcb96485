"""Token files and packing against the library, text by text."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from topicwise.llm import packing, tokenfile, tokens  # noqa: E402
from topicwise.llm.common import TEXT_ROWS, stage  # noqa: E402
from topicwise.llm.queries import pieces, tokenizer_path  # noqa: E402

from .helpers import frame, rows_of, texts  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(library):
    rng = random.Random(4)
    signs = "abcXYZÉéß'srelvdm.,!?²½ \n\t\r\xa0́ÿµªΣσİ日本​\x1c1239ñ_-"
    samples = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    samples += ["", " ", "don't WE'LL they're", "x<|endoftext|>y", "a" * 5000]
    got = tokens.encoder(tokenizer_path()).encode(samples)
    for sample, ids in zip(samples, got):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(sample, add_special_tokens=False).ids, repr(sample)


def test_cache_may_overflow(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 20)
    own = tokens.PieceEncoder(tokenizer_path())
    samples = [f"word{i} other{i % 3} x" for i in range(60)]
    for start in range(0, 60, 7):
        for sample, ids in zip(samples[start : start + 7], own.encode(samples[start : start + 7])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(sample, add_special_tokens=False).ids
    assert len(own.new) <= 40


def test_known_pieces_are_looked_up_once():
    """Of pieces that a worker knows each distinct one of a slice is looked up once, whatever its number."""

    class Counted(dict):
        reads = 0

        def get(self, key, default=None):
            self.reads += 1
            return super().get(key, default)

        def __getitem__(self, key):
            self.reads += 10
            return super().__getitem__(key)

    own = tokens.PieceEncoder(tokenizer_path())
    first = own.encode(["one two three"])
    own.new = Counted(own.new)
    assert own.encode(["one two three", "one two three"]) == first * 2
    assert own.new.reads == 3


def test_new_pieces_skip_the_whole_pipeline(library):
    """Pieces are cut and in lower case already: only the library's model sees them, not its normalizers and splitters."""
    own = tokens.PieceEncoder(tokenizer_path())
    sample = "some NEW words, 12 µß été «x» don't"
    whole = []
    own._library = lambda texts: whole.extend(texts) or []
    own.tokenizer = None
    assert np.frombuffer(own.encode([sample])[0], "<u4").tolist() == library.encode(sample, add_special_tokens=False).ids
    assert whole == []


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """A task of packing holds a few MB of texts at a time, not 10,000 of them; the session's own setting stays."""
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen, before = {}, spark.conf.get(option)

    def sizes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    def watched(df, name, *bound):
        seen[name] = bound
        return stage(df, name, *bound)

    monkeypatch.setattr(packing, "stage", watched)
    packing.pack(spark.range(30).selectExpr("id AS doc_id", "'some text' AS text"), tokenizer_path())
    assert seen["tokens"] == (TEXT_ROWS,)
    sizes = stage(spark.range(0, 2500, 1, 1).mapInArrow(sizes_of, "n long"), "sizes", TEXT_ROWS).collect()
    assert sum(r["n"] for r in sizes) == 2500 and max(r["n"] for r in sizes) <= 1000
    assert spark.conf.get(option) == before


def test_token_files(spark, library, tmp_path):
    docs = frame(spark, texts()).repartition(3)
    path = tokenfile.write_token_files(docs, tokenizer_path(), str(tmp_path / "t"))
    out = tokenfile.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] is not None for r in out] == sorted(r["doc_id"] is not None for r in out)
    named = [r["doc_id"] for r in out if r["doc_id"] is not None]
    assert named == sorted(named)
    start = 0
    for r in out:
        assert r["start"] == start
        start += r["n_tokens"]
    expected = sorted((i, len(v) + 1, crc(v + [2])) for i, t in texts() if i is not None for v in [library.encode(t or "", add_special_tokens=False).ids])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out if r["doc_id"] is not None) == expected
    assert all(".lz4." in f for f in spark.read.orc(path).inputFiles())  # zstd took the operator over its CPU budget
    found = spark.read.orc(path).filter("doc_id = 9")
    assert found.count() == 2


def test_token_files_of_nothing(spark, tmp_path):
    path = tokenfile.write_token_files(frame(spark, []), tokenizer_path(), str(tmp_path / "t"))
    assert tokenfile.read_token_files(spark, path).count() == 0


def test_packing(spark, library):
    rows = texts() + [(100 + i, t) for i, (_, t) in enumerate(texts(2))]
    sequences = packing.pack(frame(spark, rows).repartition(4), tokenizer_path(), length=64).cache()
    sizes = [r["n_tokens"] for r in sequences.orderBy("sequence_id").collect()]
    assert set(sizes[:-1]) == {64} and 0 < sizes[-1] <= 64
    out = pieces(sequences)
    for r in out.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("p")).collect():
        at = 0
        for offset, length in r["p"]:
            assert offset == at
            at += length
    expected = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        expected.setdefault((i, len(ids)), []).append(ids)
    seen = 0
    for r in out.collect():
        options = expected[(r["doc_id"], r["doc_tokens"])]
        assert any(crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for ids in options)
        seen += r["length"]
    assert seen == sum(len(ids) for v in expected.values() for ids in v)


def test_packing_nothing(spark):
    assert rows_of(pieces(packing.pack(frame(spark, []), tokenizer_path()))) == []
