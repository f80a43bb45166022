"""Periodic runs of words, found in scale tiles and stitched by document and period.

A run is a longest stretch of words that repeats with a smallest period q (words q apart are equal) and
is at least ``LEAST_WORDS`` words and ``LEAST_POWER`` periods long. For one period the places i with
word i equal to word i + q form intervals, and runs are the long ones of them.

Periods are cut into octaves [g, 2g). In each octave a document is a row of overlapping tiles around
boundaries 2g words apart, each reaching 2g words back and 5g ahead. An interval of a run is at least 3g
places long, so some boundary in it has the g words from there on inside it. A tile whose boundary words do
not come again at any distance of the octave is empty; that is one comparison of hashes over g words,
which double from octave to octave. In the other tiles Z-functions to both sides of the boundary give,
for every period at once, how far the equality reaches: an interval fragment. A tile that is periodic as
a whole with a period below g holds no run of this octave (by the theorem of Fine and Wilf) and is left.

On a cluster. A task explodes its documents into blocks of at most ``BLOCK_WORDS`` words of tiles per
octave, so what it holds besides the word numbers of a document is bounded; fragments are joined inside a block. The
fragments, few and small, go by (document, period), where fragments that touch become intervals; those
too short fall out, then those with a smaller period. Texts are not shuffled in this: only the documents with
runs are read again, and joined with their runs for the collapsed text.

Words are runs without ASCII white space, told apart by their bytes; null and empty texts have none. Rows
are told apart by number and text: rows that share both give equal results, rows that share a number
only do not mix, and rows without a number are handled like others. An empty table gives no rows. Other
columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewell.session import written

LEAST_WORDS, LEAST_POWER = 6, 4
BLOCK_WORDS = 1 << 16
# Odd multipliers of the hashes over g words; any will do, as the Z-functions decide.
_MIX = np.random.default_rng(20241107).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

Damage = Callable[[int | None, int], np.ndarray | None]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the place where it first stands."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))


def z_function(s: list[int]) -> list[int]:
    """For every place how many items from there on equal those from the start on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def least_interval(q: int) -> int:
    """Equal places q apart that make a run."""
    return max(LEAST_WORDS, LEAST_POWER * q) - q


def _tile(ids: np.ndarray, b: int, g: int, distances: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """(period, from, to, cut) of the interval of equal places around boundary b, for the distances.

    ``cut`` says that the interval may go on beyond the tile.
    """
    n = len(ids)
    lo, hi = max(0, b - 2 * g), min(n, b + 5 * g)
    tile = ids[lo:hi]
    small = int(distances[1] - distances[0]) if len(distances) > 1 else int(distances[0]) // 2
    if 0 < small < g and (tile[small:] == tile[:-small]).all():
        return
    ahead = z_function(tile[b - lo :].tolist())
    # Reversed, the words before b against those before b + q, for every q up to 2g; -1 is no word.
    end = min(n, b + 2 * g)
    back = z_function([*ids[lo:b][::-1].tolist(), -1, *ids[lo:end][::-1].tolist()])
    offset = b - lo + 1 + end - b
    for q in distances.tolist():
        reach_back, reach = min(back[offset - q], b - lo), min(ahead[q], 3 * g)
        yield q, b - reach_back, b + reach, (b - reach_back == lo and lo > 0) or (reach == 3 * g and b + reach + q < n)


def _joined(found: list[tuple[int, int, int, bool]]) -> Iterator[tuple[int, int, int]]:
    """Fragments of one block, those that touch made one; without those that are whole and too short."""
    found.sort()
    at = 0
    while at < len(found):
        q, lo, hi, cut = found[at]
        at += 1
        while at < len(found) and found[at][0] == q and found[at][1] <= hi:
            hi, cut = max(hi, found[at][2]), cut or found[at][3]
            at += 1
        if cut or hi - lo >= least_interval(q):
            yield q, lo, hi


def fragments(ids: np.ndarray, block_words: int = 0) -> Iterator[tuple[int, int, int]]:
    """(period, from, to): stretches of places i with ids[i] == ids[i + period], block by block of tiles."""
    n, g, octave = len(ids), 1, 0
    block_words = block_words or BLOCK_WORDS
    spread = ids.astype(np.uint64) * _MIX[63]
    hashes = spread ^ (spread >> np.uint64(29))  # over the g words from each place on
    while LEAST_POWER * g <= n and n >= LEAST_WORDS:
        rows = -(-len(hashes) // (2 * g))
        padded = np.zeros(rows * 2 * g, np.uint64)
        padded[: len(hashes)] = hashes
        table = padded.reshape(rows, 2 * g)
        step = max(1, block_words // (2 * g))
        for start in range(0, rows, step):
            block = table[start : start + step]
            row, column = np.nonzero(block[:, g:] == block[:, :1])
            if not len(row):
                continue
            found: list[tuple[int, int, int, bool]] = []
            change = np.flatnonzero(np.diff(row)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(row)], strict=True):
                b = (start + int(row[lo])) * 2 * g
                distances = column[lo:hi] + g
                distances = distances[b + distances + g <= n]
                if len(distances):
                    found += _tile(ids, b, g, distances)
            yield from _joined(found)
        hashes = hashes[:-g] * _MIX[octave] + hashes[g:]
        hashes ^= hashes >> np.uint64(31)
        g, octave = 2 * g, octave + 1


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Planted runs for tests: which original word stands where, or None for a text left alone.

    By crc32 of the number: one text in ten repeats its words from some place on with some period.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places >= a, a + (places - a) % p, places)


def _damaged(doc_id: str | None, words: list[bytes], damage: Damage | None) -> list[bytes]:
    places = damage(None if doc_id is None else int(doc_id), len(words)) if damage else None
    return words if places is None else [words[i] for i in places.tolist()]


def _id() -> Column:
    return F.col("doc_id").cast("string").alias("id")  # nulls and large numbers stay exact in pandas


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def tiled(docs: DataFrame, damage: Damage | None = None) -> DataFrame:
    """Fragments (id, digest, period, lo, hi) of every document, and one row per document without any.

    The row of a document without fragments has period 0 and the SHA-256 of its words in ``collapsed``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, digest, text in zip(batch["id"], batch["digest"], batch["text"], strict=True):
                words = _damaged(doc, words_of(text), damage)
                empty = True
                for q, lo, hi in fragments(numbered(words)):
                    rows.append((doc, digest, q, lo, hi, None))
                    empty = False
                if empty:
                    rows.append((doc, digest, 0, 0, 0, _sha(b" ".join(words))))
            yield pd.DataFrame(rows, columns=["id", "digest", "period", "lo", "hi", "collapsed"])

    read = docs.select(_id(), F.xxhash64("text").alias("digest"), "text")
    return read.mapInPandas(run, "id string, digest long, period long, lo long, hi long, collapsed string")


def stitched(found: DataFrame) -> DataFrame:
    """(id, digest, period, start, length): fragments of one document and period that touch, made one.

    Whole intervals that are too short for a run are left out.
    """
    key = ["id", "digest", "period"]
    order = Window.partitionBy(*key).orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", (reached.isNull() | (F.col("lo") > reached)).cast("int"))
    island = opened.withColumn("island", F.sum("opens").over(order))
    whole = island.groupBy(*key, "island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("start") + F.col("period")
    least = F.greatest(F.lit(LEAST_WORDS), LEAST_POWER * F.col("period"))
    return whole.select(*key, "start", length.alias("length")).where(F.col("length") >= least)


def _primitive(stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, period, length) of the stretches that no run of a smaller dividing period holds, in order."""
    held: dict[int, list[tuple[int, int]]] = {}
    for start, period, length in sorted(stretches, key=lambda s: s[1]):
        inside = any(
            period % p == 0 and any(s <= start and start + length <= e for s, e in spans) for p, spans in held.items() if p < period
        )
        if not inside:
            held.setdefault(period, []).append((start, start + length))
    return sorted((s, p, e - s) for p, spans in held.items() for s, e in spans)


def runs(docs: DataFrame, damage: Damage | None = None) -> DataFrame:
    """Every run: doc_id, start (word number), length, period. Rows that share number and text give their runs once."""
    return _runs(tiled(docs, damage).where("period > 0")).select(
        F.col("id").cast("long").alias("doc_id"), F.explode("runs").alias("r")
    ).select("doc_id", "r.start", "r.length", "r.period")


def _runs(found: DataFrame) -> DataFrame:
    """(id, digest, runs) per document with fragments; a document's runs are fewer than its words."""
    gathered = stitched(found).groupBy("id", "digest").agg(F.collect_list(F.struct("start", "period", "length")).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [[{"start": s, "length": n, "period": p} for s, p, n in _primitive([(r["start"], r["period"], r["length"]) for r in f])] for f in batch["found"]]
            yield pd.DataFrame({"id": batch["id"], "digest": batch["digest"], "runs": kept})

    made = gathered.mapInPandas(run, "id string, digest long, runs array<struct<start:long,length:long,period:long>>")
    every = found.select("id", "digest").distinct()  # fragments alone do not make a run
    same = every["id"].eqNullSafe(made["id"]) & (every["digest"] == made["digest"])
    return every.join(made, same, "left").select(every["id"], every["digest"], F.coalesce("runs", F.array()).alias("runs"))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without what runs (start, length, period) repeat after their first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def _summary(found: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the run with the greatest length / period, and the digest of all runs."""
    best = None
    for start, length, period in found:  # by start, then period: the first of equals stays
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    listed = _sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode())
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, listed)


_RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame, damage: Damage | None = None) -> DataFrame:
    """Per row: doc_id, the number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    found = written(tiled(docs, damage), "tiles")
    known = _runs(found.where("period > 0"))
    left, right = docs.select(_id(), F.xxhash64("text").alias("digest"), "text"), known.withColumnsRenamed({"id": "__id", "digest": "__digest"})
    texts = left.join(right, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))).select("id", "text", "runs")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, held in zip(batch["id"], batch["text"], batch["runs"], strict=True):
                listed = [(r["start"], r["length"], r["period"]) for r in held]
                words = _damaged(doc, words_of(text), damage)
                rows.append((doc, *_summary(listed), _sha(collapse(words, listed))))
            frame = pd.DataFrame(rows, columns=["id", *(c.split()[0] for c in _RESULT.split(", "))])
            numbers = ["start", "length", "period", "exponent_milli"]
            yield frame.astype(dict.fromkeys(numbers, "Int64"))

    with_runs = texts.mapInPandas(finish, f"id string, {_RESULT}")
    none = F.lit(None).cast("long")
    without = found.where("period = 0").select(
        "id", F.lit(0).cast("long").alias("n_runs"), *[none.alias(c) for c in ("start", "length", "period", "exponent_milli")],
        F.lit(_sha(b"")).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return with_runs.unionByName(without).select(F.col("id").cast("long").alias("doc_id"), *names)
