"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last bytes of a text triggers a chunk boundary wherever it hits a value that
the block size fixes, so an edit only changes the chunks that it touches. Each chunk leaves one
character of its hash in the signature. A fingerprint holds the block size and the signatures at
that size and at twice that size; two fingerprints are comparable where they share a block size, and
their likeness comes from the edit distance (insertions, deletions; a replacement counts as both)
of the signatures.

A text's neighbour in the order of doc_id may lie in another partition. Documents are dealt to
ranges between sampled numbers that are themselves documents; the document at the head of each range
is also sent to the range above it. So every task streams through its sorted rows once and finds
each row's next document on the row after it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The alphabet of the signatures, the rolling window and the wanted signature length.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
ROLLING_BYTES, SIGNATURE_CHARS, LEAST_BLOCK = 7, 64, 3
SHARED_RUN = 4
_PRIME = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_PRIME, -1, 1 << 64)
_SLICE = 1 << 16


def _powers(base: int, count: int) -> np.ndarray:
    """base^0 .. base^(count-1) modulo 2^64, by doubling."""
    out = np.ones(count, np.uint64)
    done, step = 1, base
    while done < count:
        more = min(done, count - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        step = step * step % (1 << 64)
        done *= 2
    return out


_FORWARD, _BACK = _powers(_PRIME, _SLICE + 1), _powers(_INVERSE, _SLICE + 1)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of it and the six bytes before it (fewer at the start)."""
    padded = np.concatenate([np.zeros(ROLLING_BYTES - 1, np.uint32), data.astype(np.uint32)])
    total = np.zeros(len(data), np.uint32)
    for k in range(ROLLING_BYTES):
        total = total * np.uint32(0x01000193) ^ padded[k : k + len(data)]
    total = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return total ^ (total >> np.uint32(13))


def _chunk_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every chunk, the chunks ending behind the bytes at ``ends``.

    Chunk sums of byte x prime^place are differences of running sums; dividing by prime^start makes
    them independent of the place. Long texts go slice by slice so that memory stays bounded.
    """
    sums = np.zeros(len(data) + 1, np.uint64)
    base, carry = 1, np.uint64(0)
    for start in range(0, len(data), _SLICE):
        part = data[start : start + _SLICE].astype(np.uint64) + np.uint64(1)
        run = np.cumsum(part * (_FORWARD[: len(part)] * np.uint64(base))) + carry
        sums[start + 1 : start + 1 + len(part)] = run
        carry, base = run[-1], base * pow(_PRIME, len(part), 1 << 64) % (1 << 64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = _BACK[starts % _SLICE]
    if len(data) > _SLICE:
        far = np.array([pow(_INVERSE, int(q) * _SLICE, 1 << 64) for q in range(len(data) // _SLICE + 1)], np.uint64)
        shift = shift * far[starts // _SLICE]
    h = (sums[ends + 1] - sums[starts]) * shift
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _signature(data: np.ndarray, roll: np.ndarray, block: int) -> str:
    """At most SIGNATURE_CHARS characters: the last one stands for all that follows the others."""
    ends = np.flatnonzero(roll % np.uint32(block) == block - 1)[: SIGNATURE_CHARS - 1]
    if len(data) and (not len(ends) or ends[-1] != len(data) - 1):
        ends = np.append(ends, len(data) - 1)
    if not len(ends):
        return ""
    return ALPHABET[(_chunk_hashes(data, ends) & np.uint64(63)).astype(np.intp)].tobytes().decode()


def fingerprint(text: str) -> str:
    """``block:signature:signature at twice the block``; the empty text gives ``3::``."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    block = LEAST_BLOCK
    while block * SIGNATURE_CHARS < len(data):
        block *= 2
    roll = rolling_hash(data)
    first = _signature(data, roll, block)
    while block > LEAST_BLOCK and len(first) < SIGNATURE_CHARS // 2:
        block //= 2
        first = _signature(data, roll, block)
    return f"{block}:{first}:{_signature(data, roll, 2 * block)}"


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time in one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def edit_likeness(a: str, b: str) -> float:
    """1 - edit distance / summed length; 1 for equal signatures.

    Signatures without a common run of SHARED_RUN characters are unrelated: what they share in
    scattered places is chance.
    """
    if a == b:
        return 1.0
    grams = {a[i : i + SHARED_RUN] for i in range(len(a) - SHARED_RUN + 1)}
    if min(len(a), len(b)) >= SHARED_RUN and not any(b[i : i + SHARED_RUN] in grams for i in range(len(b))):
        return 0.0
    return 2.0 * _common_length(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1: the best likeness of signatures at a block size that both fingerprints have."""
    if one == other:
        return 1.0
    a, b = one.split(":"), other.split(":")
    size_a, size_b = int(a[0]), int(b[0])
    if size_a == size_b:
        # At one block size a single chance boundary says little, so the finer one leads.
        return max(edit_likeness(a[1], b[1]), edit_likeness(a[2], b[2]) if min(len(a[2]), len(b[2])) > 8 else 0.0)
    if size_a == 2 * size_b:
        return edit_likeness(a[1], b[2])
    if size_b == 2 * size_a:
        return edit_likeness(a[2], b[1])
    return 0.0


def edited(text: str, following: str) -> str:
    """The last third of a text (rounded down) replaced by the first characters of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _heads(docs: DataFrame, ranges: int) -> list[int]:
    """Numbers of existing documents that cut the table into about ``ranges`` equal ranges.

    Each is the largest number of its range; at most ``ranges`` numbers reach the driver.
    """
    numbers = docs.where(F.col("doc_id").isNotNull()).select("doc_id")
    steps = [i / ranges for i in range(1, ranges)]
    found = numbers.agg(F.percentile_approx("doc_id", steps, 20 * ranges).alias("c")).first() if steps else None
    cuts = sorted({*((found and found["c"]) or [])})
    # Quantiles of large numbers are rounded; the largest number of each range is exact.
    tops = numbers.groupBy(_range_of(F.col("doc_id"), cuts).alias("r")).agg(F.max("doc_id").alias("top"))
    return sorted(r["top"] for r in tops.collect())


def _range_of(doc_id: Column, heads: list[int]) -> Column:
    """The place of the range whose largest number is the first head >= doc_id; two short searches."""
    if not heads:
        return F.lit(0)
    side = isqrt(len(heads)) + 1
    coarse = F.array(*map(F.lit, heads[side - 1 :: side])).cast("array<long>")
    level = F.size(F.filter(coarse, lambda h: h < doc_id))
    fine = F.slice(F.array(*map(F.lit, heads)), level * side + 1, F.lit(side))
    return F.when(doc_id.isNull(), 0).otherwise(level * side + F.size(F.filter(fine, lambda h: h < doc_id)))


_DIGESTS = (
    "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _row(doc_id, text: str, own: str, following: str, other: str) -> tuple:
    changed = edited(text, following)
    mark = fingerprint(changed) if changed != text else own
    digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
    return (doc_id, len(text), digest, own, mark, likeness(own, mark), likeness(own, other))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edit with the next document, and their likenesses.

    The next document is the one before in doc_id (descending order); after the last comes the
    first. Null texts are empty texts; rows that share a number follow each other in the order of
    their texts; rows without a number come last; a single document is its own next one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = _heads(docs, ranges) or [0]
    own = rows.withColumn("__range", _range_of(F.col("doc_id"), heads)).withColumn("__copy", F.lit(False))
    # The head of a range is the next document of the last row of the range above it; the head of
    # all comes after the last row of all. One more copy of at most ``ranges`` documents.
    above = F.pmod(_range_of(F.col("doc_id"), heads) + 1, F.lit(len(heads)))
    copies = rows.where(F.col("doc_id").isin(heads) if len(heads) > 1 or heads != [0] else F.lit(True))
    copies = copies.withColumn("__range", above).withColumn("__copy", F.lit(True))
    dealt = own.unionByName(copies).repartition(ranges, "__range")
    order = ["__range", "__copy", F.col("doc_id").desc_nulls_last(), "text"]
    # Numbers pass pandas as text: a batch with a null would turn them into floating point.
    ordered = dealt.sortWithinPartitions(*order).withColumn("doc_id", F.col("doc_id").cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            out = []
            columns = (batch[c] for c in ("__range", "__copy", "doc_id", "text"))
            for place, copy, doc_id, text in zip(*columns, strict=True):
                if copy and (waiting is None or waiting[0] != place):
                    continue  # a second copy: the range is already closed
                mark = fingerprint(text)
                if waiting is not None and waiting[0] == place:
                    out.append(_row(waiting[1], waiting[2], waiting[3], text, mark))
                waiting = None if copy else (place, doc_id, text, mark)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DIGESTS.split(", ")])

    return ordered.mapInPandas(run, _DIGESTS).withColumn("doc_id", F.col("doc_id").cast("long"))
