"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: of characters (one to three), and of words'
standings (has this word pair occurred before in the text?), which show looping texts. Each
indicator is scaled by its class log-count ratio, and a linear hinge-loss model is fitted on the
scaled indicators by dual coordinate descent. Margins from held-back thirds of the sample fix a
sigmoid that turns a margin into a score.

Fitting uses a bounded, seeded sample of the labelled rows (``sample_rows`` texts of at most
``sample_chars`` characters); scoring reads every whole text in the tasks that scan it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewell.llm.common import fit_sigmoid, fold, give_back_memory, labelled_sample, sigmoid

FEATURE_BITS = 18
THRESHOLD = 0.7
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
STANDING_RUN = 6
_SLICE = 1 << 20
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _slots(key: np.ndarray, salt: int) -> np.ndarray:
    mixed = (key ^ np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)) * _MIX[0]
    return (mixed ^ (mixed >> np.uint32(15))) * _MIX[1] >> np.uint32(32 - FEATURE_BITS)


def features(text: str, marks: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct feature numbers of a text; ``marks`` is an all-false scratch array."""
    if marks is None:
        marks = np.zeros(1 << FEATURE_BITS, bool)
    for start in range(0, len(text), _SLICE):  # two characters of overlap: every n-gram is seen
        code = np.frombuffer(text[start : start + _SLICE + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        pair = code[:-1] * _MIX[2] + code[1:]
        marks[_slots(code, 1)] = True
        marks[_slots(pair, 2)] = True
        marks[_slots(pair[:-1] * _MIX[2] + code[2:], 3)] = True
    words = text.split()
    if len(words) > STANDING_RUN:
        word = np.fromiter(map(hash, words), np.int64, len(words))
        pairs = word[:-1] * np.int64(1_000_003) + word[1:]
        _, first = np.unique(pairs, return_index=True)
        seen = np.ones(len(pairs), np.uint32)
        seen[first] = 0
        run = np.zeros(max(0, len(seen) - STANDING_RUN + 1), np.uint32)
        for i in range(STANDING_RUN):
            run = run * np.uint32(2) + seen[i : i + len(run)]
        marks[_slots(run, 4)] = True
    found = np.flatnonzero(marks)
    marks[found] = False
    return found.astype(np.int32)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # hinge-loss weight times log-count ratio, by feature
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        r = self.ratios[found]
        norm = float(np.sqrt(np.dot(r, r))) or 1.0
        return float(self.weights[found].sum()) / norm + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(found) + self.offset))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << FEATURE_BITS), smoothing)
    for found, label in zip(rows, y, strict=True):
        counts[int(label)][found] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_descent(
    rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights of the L1-loss linear SVM on unit-length ratio-scaled indicators, and its bias.

    The costs of the two classes are balanced; the bias is one more constant feature.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, c * len(y) / max(1, 2 * (y == 1).sum()), c * len(y) / max(1, 2 * (y == 0).sum()))
    scaled = []
    for found in rows:
        x = ratios[found]
        scaled.append(x / (float(np.sqrt(np.dot(x, x))) or 1.0))
    square = np.array([float(np.dot(x, x)) + 1.0 for x in scaled])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(1 << FEATURE_BITS), 0.0
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            found, x = rows[i], scaled[i]
            gradient = sign[i] * (float(np.dot(w[found], x)) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[found] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit(rows: list[np.ndarray], labels: list[int], seed: int = 7) -> QualityModel:
    """Fit on feature rows; with fewer than two classes the score is the smoothed base rate."""
    y = np.asarray(labels, int)
    size = 1 << FEATURE_BITS
    if len(set(labels)) < 2:
        rate = (float(y.sum()) + 1) / (len(y) + 2)
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(rate / (1 - rate))))

    def trained(index: np.ndarray) -> QualityModel:
        own, own_y = [rows[i] for i in index], y[index]
        ratios = log_count_ratios(own, own_y)
        w, bias = dual_descent(own, own_y, ratios, seed=seed)
        return QualityModel(w * ratios, ratios, bias, 1.0, 0.0)

    third = np.random.default_rng(seed).integers(0, 3, len(y))
    margins = np.zeros(len(y))
    for part in range(3):
        index = np.flatnonzero(third != part)
        if len(set(y[index])) == 2:
            model = trained(index)
            for i in np.flatnonzero(third == part):
                margins[i] = model.margin(rows[i])
    model = trained(np.arange(len(y)))
    slope, offset = fit_sigmoid(margins, y)
    return QualityModel(model.weights, model.ratios, model.bias, slope, offset)


def train(
    docs: DataFrame,
    labels: DataFrame,
    parts: int = 4,
    held_out: int = 2,
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
) -> QualityModel:
    drawn = labelled_sample(docs, labels, "quality", parts, held_out, sample_rows, sample_chars)
    marks = np.zeros(1 << FEATURE_BITS, bool)
    model = fit([features(text, marks) for text, _ in drawn], [label for _, label in drawn])
    del drawn
    give_back_memory()
    return model


def score(docs: DataFrame, model: QualityModel, into: str = "score") -> DataFrame:
    """All columns of ``docs`` and a score in [0, 1]; null text scores as empty text.

    Repeated rows score alike. A column already called like the new one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: two arrays of 2^18 numbers

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, marks = shared.value, np.zeros(1 << FEATURE_BITS, bool)
        for texts in batches:
            yield pd.Series([known.score(features(t or "", marks)) for t in texts], dtype="float64")

    return docs.withColumn(into, scored(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
