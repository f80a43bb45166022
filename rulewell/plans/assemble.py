"""Training-table assembly: raw generation batches to clean labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from rulewell.functions import labels
from rulewell.operators.cleaning import drop_incomplete, drop_missing
from rulewell.schemas import GENERATION_COLUMNS, GENERATION_RENAMED, TRAINING, TRAINING_COLUMNS
from rulewell.sources.csvfiles import glob_union, rename_by_position, require_columns


def clean_training(df: DataFrame) -> DataFrame:
    """Project, normalise the label, drop rows with an unusable label or a missing field."""
    projected = require_columns(df, TRAINING_COLUMNS)
    labelled = projected.withColumn("violates_rule", labels.strict("violates_rule"))
    return drop_incomplete(drop_missing(labelled, ["violates_rule"]), TRAINING_COLUMNS)


def clean_generation(df: DataFrame) -> DataFrame:
    """A raw generation batch to complete training rows; labels keep their spelling."""
    projected = require_columns(df, GENERATION_COLUMNS)
    return drop_incomplete(rename_by_position(projected, GENERATION_RENAMED), TRAINING_COLUMNS)


def training_table(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    return clean_training(glob_union(spark, patterns, TRAINING))
