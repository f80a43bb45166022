"""Completeness, length and duplicate filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewell.functions.labels import to_boolean
from rulewell.functions.text import has_text, word_count


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project to the required columns and keep rows where all of them are present."""
    return df.select(*columns).na.drop(how="any")


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset))


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows it would drop, with the counts before and after all drops."""
    complete = reduce(and_, [F.col(c).isNotNull() for c in columns])
    totals = df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(complete).alias("rows_after"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    return totals.unpivot(["rows_before", "rows_after"], list(columns), "column_name", "dropped_rows")


def add_word_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_word_count": word_count(c) for c in columns})


def max_words(df: DataFrame, columns: Sequence[str], limit: int = 120) -> DataFrame:
    return df.filter(reduce(and_, [word_count(c) <= limit for c in columns]))


def min_words(df: DataFrame, columns: Sequence[str], limit: int = 1) -> DataFrame:
    return df.filter(reduce(and_, [word_count(c) >= limit for c in columns]))


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(has_text(column))


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order``; null keys form one group.

    An aggregate rather than a ranked window: duplicates are folded before the shuffle, so a key
    held by a third of the table costs one row per task.
    """
    # Columns that are keys come back from the grouping, so long texts travel once.
    plain = [k for k in keys if isinstance(k, str)]
    computed = [k.alias(f"__key{i}") for i, k in enumerate(keys) if not isinstance(k, str)]
    rest = [c for c in df.columns if c not in plain]
    if not rest:
        return df.select(*plain).distinct()
    row = F.struct(*[F.col(c) for c in rest])
    rank = F.struct(*[F.col(c) for c in order])
    kept = df.groupBy(*plain, *computed).agg(F.min_by(row, rank).alias("__row"))
    return kept.select(*[F.col(c) if c in plain else F.col(f"__row.{c}").alias(c) for c in df.columns])


def first_seen(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """First row per name, whatever its case."""
    return keep_first(df, [F.lower(F.col(name))], order)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def valid_mask(truth: str, prediction: str) -> Column:
    """Both sides read as booleans and the prediction is not the error text."""
    return (
        to_boolean(truth).isNotNull()
        & to_boolean(prediction).isNotNull()
        & (F.col(prediction).cast("string") != "Error")
    )
