"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's subwords are its character n-grams (three to five, with the word's bounds), hashed into
buckets that each have an embedding. The embeddings of a window of words are averaged and a linear
softmax over two classes reads the average. Misspelt words that were never seen share most n-grams,
and so vectors, with those that were. A document is as toxic as its most toxic window, so that one
passage in a long text is not averaged away: each round of training picks the window that scores
highest in every document (with a few drawn ones from clean documents) and moves embeddings and
softmax together along its gradient.

Both classes' softmax rows act on the same average, so a trained bucket comes down to one number,
its embedding times the difference of the rows; scoring reads whole texts with that table.
Fitting uses a bounded, seeded sample of labelled rows (``sample_rows`` texts of at most
``sample_chars`` characters).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewell.llm.common import fit_sigmoid, fold, give_back_memory, labelled_sample, sigmoid

BUCKET_BITS = 17
DIMENSIONS = 12
SIZES = (3, 4, 5)
WINDOW_WORDS = 4
THRESHOLD = 0.7
LEAST_TEXTS, PRIOR_TEXTS = 4, 5.0
EPOCHS, RATE, DOUBT = 6, 0.05, 0.1
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
_SLICE = 1 << 19
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with a space for everything but letters and digits."""
    return _letters_of(np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4"))


def _letters_of(code: np.ndarray) -> np.ndarray:
    # ASCII by its classes; beyond ASCII only punctuation blocks and spaces are no letters.
    ascii_word = ((code >= 97) & (code <= 122)) | ((code >= 48) & (code <= 57))
    beyond = (code >= 0xC0) & ~((code >= 0x2000) & (code <= 0x206F)) & (code != 0x3000)
    return np.where(ascii_word | beyond, code, np.uint32(32))


def subwords(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket of every subword, number of its word, number of words), subwords grouped by size."""
    code = _letters(text)
    gap = code == 32
    starts = gap[:-1] & ~gap[1:]
    word = np.cumsum(starts, dtype=np.int32) - 1  # at i: the word that begins at i + 1, or the one inside
    n_words = int(word[-1]) + 1 if len(word) else 0
    buckets, words = [], []
    inner = np.zeros(len(code), bool)
    key = code.copy()
    for size in range(2, max(SIZES) + 1):
        if len(code) < size:
            break
        key = key[: len(code) - size + 1] * _MIX[2] + code[size - 1 :]
        inner = inner[: len(key)] | (gap[size - 2 : size - 2 + len(key)] if size > 2 else False)
        if size in SIZES:
            keep = np.flatnonzero(~inner)  # no space inside; one may stand at either end
            mixed = (key[keep] ^ np.uint32(size * 0x27D4EB2F & 0xFFFFFFFF)) * _MIX[0]
            buckets.append((mixed ^ (mixed >> np.uint32(15))) * _MIX[1] >> np.uint32(32 - BUCKET_BITS))
            words.append(word[np.minimum(keep, len(word) - 1)])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32), n_words
    return np.concatenate(buckets), np.concatenate(words), n_words


def _word_starts(text: str) -> np.ndarray:
    """Where the words of ``subwords`` begin in a text that begins at a word's start or outside words."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    upper = (code >= 65) & (code <= 90)
    gap = (_letters_of(code) == 32) & ~upper
    return np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))


def _slices(text: str) -> Iterator[str]:
    """The text in pieces of whole words; a piece begins with the WINDOW_WORDS - 1 words that ended the one before.

    So every window of words is in one piece. Pieces are longer than _SLICE only where so few words are.
    """
    start, reach = 0, _SLICE
    while start + reach < len(text):
        begins = _word_starts(text[start : start + reach])
        if len(begins) <= WINDOW_WORDS:
            reach *= 2
            continue
        yield text[start : start + int(begins[-1])]
        start, reach = start + int(begins[-WINDOW_WORDS]), _SLICE
    yield text[start:]


@dataclass(frozen=True)
class ToxicityModel:
    table: np.ndarray  # per bucket: embedding times the difference of the softmax rows
    bias: float
    slope: float
    offset: float

    def margin(self, text: str) -> float:
        """The log-odds of the most toxic window; a text without words has the bias alone."""
        return max((self._margin(part) for part in _slices(text)), default=self.bias)

    def _margin(self, text: str) -> float:
        bucket, word, n_words = subwords(text)
        if not n_words:
            return self.bias
        total = np.bincount(word, self.table[bucket], n_words)
        count = np.bincount(word, minlength=n_words)
        return float(window_means(total, count).max()) + self.bias

    def score(self, text: str) -> float:
        return float(sigmoid(self.slope * self.margin(text) + self.offset))


def window_means(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mean over the subwords of every window of WINDOW_WORDS consecutive words (or of all words)."""
    size = min(WINDOW_WORDS, len(total))
    t = np.concatenate([[0.0], np.cumsum(total)])
    c = np.concatenate([[0], np.cumsum(count)])
    return (t[size:] - t[:-size]) / np.maximum(1, c[size:] - c[:-size])


class Trainer:
    """Embeddings and softmax under one loss, moved together on batches of windows."""

    def __init__(self, seed: int = 11):
        self.draw = np.random.default_rng(seed)
        self.embedding = self.draw.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
        self.softmax = self.draw.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.known = np.ones(1 << BUCKET_BITS, np.float32)
        self._moments = [np.zeros_like(p) for p in (self.embedding, self.softmax, self.bias)]

    def start(self, guess: np.ndarray, known: np.ndarray) -> None:
        """Let the first dimension begin with what counting says; training moves all of them."""
        self.embedding[:, 0] += guess.astype(np.float32)
        self.softmax[0] += np.array([-0.5, 0.5], np.float32)
        self.known = known

    def table(self) -> np.ndarray:
        return (self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])) * self.known

    def step(self, windows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        lengths = np.array([len(w) for w in windows])
        flat, owner = np.concatenate(windows), np.repeat(np.arange(len(windows)), lengths)
        mean = np.zeros((len(windows), DIMENSIONS), np.float32)
        np.add.at(mean, owner, self.embedding[flat] * self.known[flat, None])
        mean /= lengths[:, None]
        logits = mean @ self.softmax + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        error = p * (weight / weight.sum())[:, None]
        back = (error @ self.softmax.T) / lengths[:, None]
        grad = np.zeros_like(self.embedding)
        np.add.at(grad, flat, back[owner] * self.known[flat, None])
        moves = [(self.embedding, grad, 1.0), (self.softmax, mean.T @ error, 1.0), (self.bias, error.sum(axis=0), 0.2)]
        self._move(moves, rate)

    def _move(self, pairs: list[tuple[np.ndarray, np.ndarray, float]], rate: float) -> None:
        """Momentum steps, scaled as a whole so that the largest coordinate moves by ``rate``.

        Unlike a scale per coordinate, this leaves subwords of single texts behind those of many.
        """
        for (value, grad, share), moment in zip(pairs, self._moments, strict=True):
            moment *= 0.9
            moment += grad
            value -= (share * rate * moment / (float(np.abs(moment).max()) + 1e-12)).astype(np.float32)


def _first_guess(docs: list[_Document], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log odds, known) per bucket: how much more often toxic texts have a subword than clean ones.

    Shares of texts are pulled towards the overall share as if PRIOR_TEXTS more texts had it; buckets
    that fewer than LEAST_TEXTS texts have stay unknown, they would only learn single labels.
    """
    count = np.zeros((2, 1 << BUCKET_BITS))
    for doc, label in zip(docs, y, strict=True):
        count[label][np.unique(doc.bucket)] += 1
    overall = count.sum(axis=0) / max(1, len(docs))
    sizes = np.array([[(y == 0).sum()], [(y == 1).sum()]])
    share = (count + PRIOR_TEXTS * overall + 1e-9) / (sizes + PRIOR_TEXTS)
    known = count.sum(axis=0) >= LEAST_TEXTS
    return np.log(share[1] / share[0]) * known, known.astype(np.float32)


class _Document:
    def __init__(self, text: str):
        bucket, word, self.n_words = subwords(text)
        order = np.argsort(word, kind="stable")
        self.bucket = bucket[order].astype(np.int32)
        self.count = np.bincount(word, minlength=self.n_words)
        self.bounds = np.concatenate([[0], np.cumsum(self.count)])

    def windows(self, table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(table[self.bucket])])[self.bounds]
        return window_means(np.diff(sums), self.count)

    def window(self, at: int) -> np.ndarray:
        return self.bucket[self.bounds[at] : self.bounds[min(at + WINDOW_WORDS, self.n_words)]]


def fit(texts: list[str], labels: list[int], epochs: int | None = None, seed: int = 11) -> ToxicityModel:
    """Fit on texts; with fewer than two classes the score is the smoothed base rate.

    A fifth of the texts is held back from the embeddings and fixes the sigmoid.
    """
    y = np.asarray(labels, int)
    if len(set(labels)) < 2:
        rate = (float(y.sum()) + 1) / (len(y) + 2)
        return ToxicityModel(np.zeros(1 << BUCKET_BITS), 0.0, 1.0, float(np.log(rate / (1 - rate))))
    docs = [_Document(t) for t in texts]
    trainer = Trainer(seed)
    draw = trainer.draw
    kept = np.flatnonzero((draw.random(len(y)) >= 0.2) & np.array([d.n_words > 0 for d in docs]))
    trainer.start(*_first_guess([docs[i] for i in kept], y[kept]))
    weight_of = np.where(y == 1, len(y) / (2.0 * max(1, y.sum())), len(y) / (2.0 * max(1, (1 - y).sum())))
    epochs = EPOCHS if epochs is None else epochs
    batch = min(128, max(16, len(kept) // 16))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = draw.permutation(kept)
        for start in range(0, len(order), batch):
            table = trainer.table()
            windows, target, weight = [], [], []
            for i in order[start : start + batch]:
                scores = docs[i].windows(table)
                picked = [int(scores.argmax())]
                agrees = sigmoid((scores[picked[0]] + trainer.bias[1] - trainer.bias[0]) * (2 * y[i] - 1))
                if epoch and agrees < DOUBT:
                    continue  # after the first round a label that all else speaks against is noise
                if y[i] == 0:
                    picked += draw.integers(0, len(scores), 3).tolist()
                for at in picked:
                    windows.append(docs[i].window(at))
                    target.append(y[i])
                    weight.append(weight_of[i] / len(picked))
            whole = [j for j, w in enumerate(windows) if len(w)]
            if whole:
                trainer.step(
                    [windows[j] for j in whole], np.array(target)[whole], np.array(weight)[whole], rate
                )
    bias = float(trainer.bias[1] - trainer.bias[0])
    model = ToxicityModel(trainer.table().astype(np.float64), bias, 1.0, 0.0)
    rest = np.setdiff1d(np.arange(len(y)), kept)
    rest = rest if len(set(y[rest].tolist())) == 2 and len(rest) >= 40 else np.arange(len(y))
    margins = np.array([model.margin(texts[i]) for i in rest])
    slope, offset = fit_sigmoid(margins, y[rest])
    return ToxicityModel(model.table, bias, slope, offset)


def train(
    docs: DataFrame,
    labels: DataFrame,
    parts: int = 3,
    held_out: int = 1,
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
) -> ToxicityModel:
    drawn = labelled_sample(docs, labels, "toxic", parts, held_out, sample_rows, sample_chars)
    model = fit([text for text, _ in drawn], [label for _, label in drawn])
    del drawn
    give_back_memory()
    return model


def score(docs: DataFrame, model: ToxicityModel, into: str = "score") -> DataFrame:
    """All columns of ``docs`` and a score in [0, 1]; null text scores as empty text.

    Repeated rows score alike. A column already called like the new one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one number per bucket

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for texts in batches:
            yield pd.Series([known.score(t or "") for t in texts], dtype="float64")

    return docs.withColumn(into, scored(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
