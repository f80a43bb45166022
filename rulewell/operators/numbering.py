"""Row numbers over large tables without a one-task window.

A plain ``row_number()`` over an unpartitioned (or hot) window runs in one task. Here rows are cut
into ordered buckets, the buckets are counted, a prefix sum over the bucket counts gives each
bucket its offset, and ``row_number()`` runs inside the buckets only. The prefix sum is over one
row per bucket (and group).
"""

from __future__ import annotations

from math import ceil, log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewell.functions.sampling_keys import hash_key

_BUCKET, _LEVEL, _FINE, _OFFSET, _HASH, _AHEAD = "__bucket", "__level", "__fine", "__offset", "__hash", "__ahead"

# Sampled keys per bucket when the bucket bounds are estimated.
SAMPLE_PER_BUCKET = 200
# Rows of a bucket from which on more buckets are made; MOST_SIDE squared bounds what is collected.
BUCKET_ROWS, MOST_SIDE = 5_000_000, 256
_MILLIARD = 1_000_000_000


def _side(df: DataFrame, rows: int) -> int:
    """Buckets per level: two per shuffle partition, and more while a bucket would pass BUCKET_ROWS."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_SIDE, max(4, ceil(sqrt(max(2 * partitions, rows / BUCKET_ROWS)))))


def _quantile_bucketed(df: DataFrame, key: str, side: int | None) -> DataFrame:
    """Add an order-preserving bucket in [0, side*side): a two-level search among quantiles.

    The rows are counted and the quantiles of a hash sample of bounded size are taken once, before
    the plan that uses them, so every part of that plan sees the same bounds. Bounds only decide how
    even the buckets are, never the numbers.
    """
    rows = df.count()
    side = side or _side(df, rows)
    steps = [i / (side * side) for i in range(1, side * side)]
    share = float(SAMPLE_PER_BUCKET * side * side * _MILLIARD) / max(1, rows)
    sample = df.select(key).filter(F.pmod(F.xxhash64(key), F.lit(_MILLIARD)) < F.lit(share))
    bounds = sorted(sample.agg(F.percentile_approx(key, steps, 10000).alias("b")).first()["b"] or [0] * len(steps))
    coarse = F.array(*[F.lit(bounds[i * side - 1]) for i in range(1, side)])

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < F.col(key)))

    leveled = df.withColumn(_LEVEL, below(coarse))
    # A row a level, of side - 1 bounds: at most MOST_SIDE squared numbers, kept out of the plan's expressions.
    kind = T.StructType([T.StructField(_LEVEL, T.IntegerType()), T.StructField(_FINE, T.ArrayType(df.schema[key].dataType))])
    fine = df.sparkSession.createDataFrame([(i, bounds[i * side : (i + 1) * side - 1]) for i in range(side)], kind)
    placed = leveled.join(F.broadcast(fine), _LEVEL)
    return placed.withColumn(_BUCKET, F.col(_LEVEL) * side + below(F.col(_FINE))).drop(_LEVEL, _FINE)


def number_rows(
    df: DataFrame,
    key: str,
    into: str = "rn",
    within: tuple[str, ...] = (),
    total: str | None = None,
    side: int | None = None,
) -> DataFrame:
    """Add the zero-based position of each row by a unique numeric ``key``, optionally per group.

    ``total`` names a column for the group's row count. ``side`` squared is the number of buckets.
    """
    bucketed = _quantile_bucketed(df, key, side)
    return _number(bucketed, [F.col(key)], into, within, total)


def number_rows_by_hash(
    df: DataFrame, key: str, seed: int, into: str = "rn", total: str | None = None, digits: int | None = None
) -> DataFrame:
    """Zero-based position in the seeded random order; buckets are digest prefixes, hence even."""
    digits = digits or max(3, ceil(log(max(1, df.count() / BUCKET_ROWS), 16)))
    hashed = df.withColumn(_HASH, hash_key(key, seed))
    bucketed = hashed.withColumn(_BUCKET, F.substring(_HASH, 1, digits))
    return _number(bucketed, [F.col(_HASH), F.col(key)], into, (), total).drop(_HASH)


def _number(
    bucketed: DataFrame, order: list[Column], into: str, within: tuple[str, ...], total: str | None
) -> DataFrame:
    keys = [*within, _BUCKET]
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias(_OFFSET),
        *([F.sum("__n").over(group).cast("long").alias(total)] if total else []),
    )
    # The offset of a bucket goes before its rows in the same window, so that rows move once.
    first = [F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]
    ahead = offsets.select(*first, _OFFSET, *([total] if total else []), F.lit(True).alias(_AHEAD))
    both = bucketed.unionByName(ahead, allowMissingColumns=True)
    inner = Window.partitionBy(*keys).orderBy(F.col(_AHEAD).isNull(), *order)
    so_far = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {total: F.first(total).over(so_far)} if total else {}
    numbers = {into: F.first(_OFFSET).over(so_far) + F.row_number().over(inner) - 2}
    return both.withColumns(totals | numbers).filter(F.col(_AHEAD).isNull()).drop(_AHEAD, _OFFSET, _BUCKET)
