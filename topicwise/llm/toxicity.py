"""Toxicity by bags of subwords: the mean of learned character n-gram vectors goes into a linear softmax.

A few words decide, and in a long text their mean drowns, so a text is scored window by window and its worst window counts.

Vectors and softmax are trained together in numpy on a bounded sample of labelled texts. A misspelling never seen in
training shares most n-grams with its word, so it shares the word's direction too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwise.llm.common import give_back

WORD = re.compile(r"\w+")
#: Words whose contribution a Python worker keeps, and characters of text scored together.
KEPT_WORDS = 500_000
SLICE_CHARS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` labelled texts of at most ``sample_chars`` characters bound what the driver fits on; at most half of them
    are of class 1.

    A text is seen in windows of ``window`` words, half overlapping. ``gain`` multiplies the mean of a window.
    N-grams in fewer than ``least_bags`` training texts (fewer where the sample is small) are left out.
    One text in ``held`` is kept out of training and used to calibrate.
    """

    sample_rows: int = 5000
    sample_chars: int = 6_000
    window: int = 24
    rounds: int = 2
    clean_windows: int = 2
    buckets: int = 1 << 20
    least_bags: int = 15
    dim: int = 4
    shortest: int = 3
    longest: int = 5
    gain: float = 30.0
    held: int = 4
    epochs: int = 5
    rate: float = 0.05
    seed: int = 5


def units(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of every word between end marks, and of every whole word; sorted by word."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    size = np.array([len(w) + 2 for w in words], "int64")
    owner = np.repeat(np.arange(len(words)), size)
    prime = np.uint64(1_099_511_628_211)
    spread = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    gram, owners, hashes = spread.copy(), [], []
    for n in range(2, s.longest + 1):
        gram = gram[:-1] * prime + spread[n - 1 :]
        if len(gram) and n >= s.shortest:
            inside = owner[: len(gram)] == owner[n - 1 :]
            owners.append(owner[: len(gram)][inside])
            hashes.append(gram[inside])
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(spread * ((place.astype("uint64") * np.uint64(2) + np.uint64(1)) ** np.uint64(3)), np.cumsum(size) - size)
    owners, hashes = np.concatenate([*owners, np.arange(len(words))]), np.concatenate([*hashes, whole])
    order = np.argsort(owners, kind="stable")
    hashes = hashes[order]
    hashes ^= hashes >> np.uint64(29)
    return owners[order], ((hashes * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype("int64") % s.buckets


class Model:
    """Vectors of n-gram buckets, folded with the softmax into one number per bucket: class 1 against class 0."""

    def __init__(self, settings: Settings, weight: np.ndarray, bias: float):
        self.settings, self.weight, self.bias = settings, weight, bias
        self.kept: dict[str, float] = {}

    def windows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Log odds of class 1 of every window of each text (its words); one value, the bias, where there is no word."""
        new = list({w for words in texts for w in words if w not in self.kept})
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
            new = list({w for words in texts for w in words})
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            owner, bucket = units(some, self.settings)
            mean = np.bincount(owner, self.weight[bucket], len(some)) / np.bincount(owner, minlength=len(some))
            self.kept.update(zip(some, mean.tolist()))
        get, out = self.kept.__getitem__, []
        for words in texts:
            sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(get, words), "float64", len(words)))])
            begin, end = spans(len(words), self.settings.window)
            out.append((sums[end] - sums[begin]) / np.maximum(end - begin, 1) + self.bias)
        return out

    def scores(self, texts: list[str]) -> list[float]:
        """Probability of class 1 of each text: that of its worst window."""
        worst = np.array([found.max() for found in self.windows([distinct(t) for t in texts])])
        return (1 / (1 + np.exp(-np.clip(worst, -60, 60)))).tolist()


def distinct(text: str) -> list[str]:
    """The words of a text, each once, by first place: what is repeated does not outweigh the rest."""
    return list(dict.fromkeys(WORD.findall(text.lower())))


def spans(words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of windows over a text of so many words; at least one, and the last one reaches the end."""
    begin = np.arange(0, max(words - window // 2, 1), window // 2)
    begin = np.minimum(begin, max(words - window, 0))
    return begin, np.minimum(begin + window, words)


def fit(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """Train vectors (buckets x dim) and softmax (dim x 2) jointly.

    Labels hold for texts, so training alternates: first on whole texts, then on the windows that the last model finds
    worst, one of each text of class 1 and some of each text of class 0. Without both classes the score is constant.
    """
    labels = np.asarray(labels, "int64")
    if not len(labels) or labels.min() == labels.max():
        return Model(s, np.zeros(s.buckets, "float32"), 30.0 if len(labels) and labels[0] else -30.0)
    cut = [distinct(t) for t in texts]
    rest = np.arange(len(cut)) % s.held == 0  # for the calibration
    if len(set(labels[rest])) < 2 or len(set(labels[~rest])) < 2:
        rest[:] = False
    fitted, truths = [w for w, r in zip(cut, rest) if not r], labels[~rest]
    bags, truth = fitted, truths
    model = _train(bags, truth, s)
    for _ in range(s.rounds):
        bags, truth = [], []
        for words, label, odds in zip(fitted, truths, model.windows(fitted)):
            begin, end = spans(len(words), s.window)
            for i in np.argsort(-odds, kind="stable")[: 1 if label else s.clean_windows]:
                bags.append(words[begin[i] : end[i]])
                truth.append(label)
        model = _train(bags, np.array(truth), s)
    return _calibrated(model, [w for w, r in zip(cut, rest) if r], labels[rest])


def _calibrated(model: Model, texts: list[list[str]], labels: np.ndarray) -> Model:
    """Scale and shift the log odds so that 0 parts texts the model has not seen best: logistic regression on one number."""
    if not len(texts):
        return model
    odds = np.array([found.max() for found in model.windows(texts)])
    x = np.stack([odds, np.ones_like(odds)], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(25):  # Newton steps, slightly ridged towards the line as it is
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        line -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (p - labels) + 0.1 * (line - [1.0, 0.0]))
    if line[0] <= 0:
        return model
    return Model(model.settings, model.weight * np.float32(line[0]), float(model.bias * line[0] + line[1]))


def _train(bags: list[list[str]], labels: np.ndarray, s: Settings) -> Model:
    """One text at a time, AdaGrad steps. A bag is the mean of its words, a word the mean of its units."""
    sparse = []
    for words in bags:
        if words:
            owner, bucket = units(words, s)
            found, place = np.unique(bucket, return_inverse=True)
            share = (s.gain / len(words)) / np.bincount(owner)[owner]
            sparse.append((found, np.bincount(place, share).astype("float32")))
        else:
            sparse.append((np.zeros(0, "int64"), np.zeros(0, "float32")))
    common = np.bincount(np.concatenate([b for b, _ in sparse]), minlength=s.buckets) >= min(s.least_bags, 2 + len(bags) // 300)
    sparse = [(b[common[b]], w[common[b], None]) for b, w in sparse]
    truth = np.eye(2, dtype="float32")[labels]
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-0.05, 0.05, (s.buckets, s.dim)).astype("float32")
    vectors[~common] = 0
    softmax, bias = (rng.normal(0, 1, (s.dim, 2)) / np.sqrt(s.dim)).astype("float32"), np.zeros(2, "float32")
    seen, seen_softmax, seen_bias = np.full_like(vectors, 1e-8), np.full_like(softmax, 1e-8), np.full_like(bias, 1e-8)
    rate = np.float32(s.rate)
    for _ in range(s.epochs):
        for i in rng.permutation(len(sparse)):
            bucket, weight = sparse[i]
            mean = (vectors[bucket] * weight).sum(axis=0)
            logits = mean @ softmax + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum() - truth[i]
            back = weight * (softmax @ error)
            change = np.outer(mean, error)
            seen[bucket] += back * back
            seen_softmax += change * change
            seen_bias += error * error
            vectors[bucket] -= rate * back / np.sqrt(seen[bucket])
            softmax -= rate * change / np.sqrt(seen_softmax)
            bias -= rate * error / np.sqrt(seen_bias)
    return Model(s, (vectors @ (softmax[:, 1] - softmax[:, 0])) * np.float32(s.gain), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int]]:
    """At most ``sample_rows`` labelled texts, chosen by a hash of the id; class 1 has up to half of them, as it is the rare one.

    Labels other than 0 and 1 and null ids and texts are left out.
    """
    chosen = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1)")
    chosen = chosen.groupBy("i").agg(F.max("y").alias("y"))  # an id labelled twice counts once, as 1 if one label says so
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    texts = texts.filter(F.col("t").isNotNull() & (F.length("t") <= s.sample_chars))
    order = F.xxhash64(F.lit(s.seed), "i", "t").alias("h")
    rows = []
    for label, wanted in ((1, s.sample_rows // 2), (0, s.sample_rows)):
        wanted -= len(rows)
        # More candidates than wanted, as some have no text or too long a one; their number is bounded, so is the broadcast.
        some = chosen.filter(F.col("y") == label).orderBy(F.xxhash64(F.lit(s.seed), "i"), "i").limit(2 * wanted)
        rows += texts.join(F.broadcast(some), "i").select(order, "t", "y").orderBy("h", "t").limit(wanted).collect()
    rows.sort(key=lambda r: (r["h"], r["t"]))
    return [r["t"] for r in rows], [r["y"] for r in rows]


def train(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """A model fitted on :func:`sample`. Without both classes among the labels, or with empty tables, the score is constant."""
    model = fit(*sample(docs, labels, settings, id_col, text_col, label_col), settings)
    give_back()  # most of what the fit took
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col`` (replacing a column of that name): the score of each whole text. Null and empty texts get the bias's
    score. Rows are kept as they are, repeated ones too; an empty table stays empty. No shuffle."""
    settings, weight, bias = model.settings, model.weight, model.bias
    shared = docs.sparkSession.sparkContext.broadcast((settings, weight, bias))  # one number per bucket

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(*shared.value)
        for batch in batches:
            texts, out, start, chars = [t or "" for t in batch], [], 0, 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars >= SLICE_CHARS or i == len(texts) - 1:
                    out += model.scores(texts[start : i + 1])
                    start, chars = i + 1, 0
            yield pd.Series(out, dtype="float64")

    return docs.withColumn(score_col, scores(F.col(text_col)))
