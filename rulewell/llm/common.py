"""What the training-data operators share: reading, label folds, bounded samples, word patterns."""

from __future__ import annotations

import ctypes

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space and word classes that the contracts name; plain ASCII, not Unicode white space.
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column | str) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Non-empty runs of characters that are not ASCII white space; null gives no words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANK}+"))


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the document number as text, modulo ``parts``; null for a null number."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, rows: int, max_chars: int
) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` labelled documents outside the held-out fold.

    The rows are those with the smallest seeded hash of doc_id among all labelled rows, so the
    sample does not depend on partitioning. Fitting alone leaves out texts beyond ``max_chars``;
    rows times max_chars bounds what reaches the driver. A document labelled twice counts once,
    with its largest label; null labels and null numbers are no labels.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(fold("doc_id", parts) != held_out).groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
    usable = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows)
    # At most ``rows`` numbers and labels: the one side whose size is fixed by a parameter.
    joined = usable.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    picked = joined.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "text").limit(rows)
    return [(r["text"], r["__y"]) for r in picked.select("text", "__y").collect()]


def give_back_memory() -> None:
    """Return what Python has freed to the system, where the C library can: a driver lives long after a model is fitted."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit_sigmoid(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of P(y=1 | margin), by damped Newton steps on smoothed targets."""
    n_pos, n_neg = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    a, b = 1.0, float(np.log((n_pos + 1) / (n_neg + 1)))
    for _ in range(steps):
        p = sigmoid(a * margins + b)
        grad = np.array([np.dot(p - target, margins), (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[np.dot(w, margins**2), np.dot(w, margins)], [np.dot(w, margins), w.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        size = min(1.0, 2.0 / (1e-9 + float(np.abs(step).max())))
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-7:
            break
    return (max(a, 1e-3), b)
