"""Counts and distributions. Every report is one map-side combined aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewell.functions.text import word_count


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def group_size_stats(df: DataFrame, column: str) -> DataFrame:
    sizes = value_counts(df, column)
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg("count").alias("mean_size"),
        F.median("count").alias("median_size"),
        F.min("count").alias("min_size"),
        F.max("count").alias("max_size"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of distinct non-null values.

    Exploded to (column, value) pairs so that one partial aggregate serves all columns instead of
    a row expansion per distinct aggregate.
    """
    pairs = df.unpivot([], list(columns), "column_name", "value").filter(F.col("value").isNotNull())
    counts = pairs.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    joined = names.join(counts, "column_name", "left")
    return joined.select("column_name", F.coalesce("n", F.lit(0)).alias("distinct_values"))


def word_histogram(df: DataFrame, columns: Sequence[str], bins: int = 100) -> DataFrame:
    """Equal-width histogram of word counts per column; the last bin is closed.

    The texts are read once: they fold to (column, words) frequencies, and the bins are cut from
    those.
    """
    counts = df.select(*[word_count(c).cast("long").alias(c) for c in columns])
    frequencies = (
        counts.unpivot([], list(columns), "column_name", "words")
        .groupBy("column_name", "words")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    limits = frequencies.groupBy("column_name").agg(F.min("words").alias("lo"), F.max("words").alias("hi"))
    width = F.when(F.col("hi") == F.col("lo"), F.lit(1.0 / bins)).otherwise((F.col("hi") - F.col("lo")) / bins)
    low = F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5).otherwise(F.col("lo").cast("double"))
    placed = frequencies.join(limits, "column_name").withColumn(
        "bin", F.least(F.lit(bins - 1), F.floor((F.col("words") - low) / width)).cast("int")
    )
    return placed.groupBy("column_name", "bin").agg(F.sum("n").alias("frequency"))


def generation_summary(df: DataFrame, community: str = "subreddit", rule: str = "rule") -> DataFrame:
    """Totals of a generation run: successes, errors, communities, rules, formatted rules, examples."""
    total = F.count(F.lit(1))
    errors = F.count_if(F.col("error").isNotNull())
    return df.agg(
        total.alias("total"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        errors.alias("failed"),
        F.coalesce(F.try_divide((total - errors) * 100.0, total), F.lit(0.0)).alias("success_percent"),
        F.coalesce(F.try_divide(errors * 100.0, total), F.lit(0.0)).alias("error_percent"),
        F.count_distinct(community).alias("communities"),
        F.count_distinct(rule).alias("rules"),
        F.count("formatted_rule").alias("formatted"),
        F.count("positive_example_1").alias("with_examples"),
    )


def clarity_counts(df: DataFrame, tag: str = "clarity_tag") -> DataFrame:
    return df.agg(
        F.count_if(F.col(tag) == "Clear").alias("clear"),
        F.count_if(F.col(tag) == "Unclear").alias("unclear"),
    )


def unclear_rows(df: DataFrame, key: str, n: int = 5, tag: str = "clarity_tag") -> DataFrame:
    return df.filter(F.col(tag) == "Unclear").orderBy(key).limit(n)


def class_balance(df: DataFrame, label: str = "rule_violation") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
    )


def padded_labels(df: DataFrame, scoring: str, train: str, kind: str) -> DataFrame:
    """One aligned label per combination, padded to the longest text of each column."""
    combos = df.select(scoring, train, kind).distinct()
    widest = {c: combos.agg(F.max(F.length(c))).scalar() for c in (scoring, train)}
    pad = lambda c: F.rpad(F.col(c), widest[c], F.lit(" "))
    return combos.withColumn("label", F.concat_ws(" | ", pad(scoring), pad(train), F.col(kind)))


def retrieval_profile(decisions: DataFrame) -> DataFrame:
    """Rows per (match kind, neighbours found, reranked)."""
    kind = F.regexp_extract("rule_match_type", "^[a-z_]+", 0)
    return decisions.groupBy(kind.alias("match_kind"), "num_retrieved", "reranked").agg(
        F.count(F.lit(1)).alias("queries")
    )


def reduction_report(scored: DataFrame, similarity: str, threshold: float) -> DataFrame:
    total = F.count(F.lit(1))
    kept = F.count_if(F.col(similarity) >= threshold)
    return scored.agg(
        total.alias("original"),
        kept.alias("kept"),
        F.coalesce((1 - F.try_divide(kept, total)) * 100.0, F.lit(0.0)).alias("reduction_percent"),
    )
