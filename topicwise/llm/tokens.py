"""Token ids by the ``tokenizers`` library, encoded once per distinct word of a stream of batches.

The tokenizer cuts a text into words, digits and runs of signs, and encodes each by itself, so a text's ids are those of its
pieces one after another. Each Python worker keeps the ids of pieces it has met (bounded) and hands only new ones to the library.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pieces that a Python worker keeps, in two generations of this size; longer pieces are encoded each time.
KEPT_PIECES = 500_000
KEPT_LENGTH = 64
#: Characters of text encoded together.
SLICE_CHARS = 80_000


# The tokenizer's own splitting rule, written out for lower-case texts of Latin-1 characters.
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
PIECE = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\r{LETTERS}{NUMBERS}]+")
UNUSUAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0]")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class PieceEncoder:
    """Ids of texts, piece by piece. What cannot be cut safely goes to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokens = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Pieces are cut and in lower case, so the library's model takes them as they are, in its alphabet of bytes.
        self.model = self.tokenizer.model
        alphabet = {i: c for c, i in byte_alphabet().items()}
        self.shown = {i: "".join(alphabet[x] for x in chr(i).encode()) for i in range(0xA1, 0x100)}
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece."""
        found = self.model.tokenize(piece if piece.isascii() else piece.translate(self.shown))
        return b"".join([self.packed[t.id] for t in found])

    def _learn(self, pieces: set[str]) -> None:
        """Add the ids of pieces to ``self.new``, from the old generation or from the library."""
        for p in pieces:
            ids = self.old.get(p)
            self.new[p] = self._piece(p) if ids is None else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        here = set().union(*filter(None, cut))
        if len(self.new) + len(here) > KEPT_PIECES:
            self.old, self.new = self.new, {}
        # Small: stays in the processor's cache.
        known = dict(zip(here, map(self.new.get, here)))
        unknown = {p for p, ids in known.items() if ids is None}
        self._learn(unknown)
        known.update(zip(unknown, map(self.new.__getitem__, unknown)))
        whole = iter(self._library([t for t, pieces in zip(texts, cut) if pieces is None]))
        out = [next(whole) if pieces is None else b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for p in unknown:
            if len(p) > KEPT_LENGTH:
                del self.new[p]
        return out

    def _cut(self, text: str) -> list[str] | None:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                text = None
        if text is None or UNUSUAL.search(text) or any(t in text for t in self.tokens):
            return None
        return PIECE.findall(text.lower())


@functools.cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches, each with the ids of its texts (null: empty), the end id appended."""
    words = encoder(path)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        start = chars = 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars >= SLICE_CHARS or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), [ids + end for ids in words.encode(texts[start : i + 1])]
                start, chars = i + 1, 0
