"""Batch model scoring and its evaluation."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewell.functions import labels, prompts
from rulewell.operators.evaluation import binary_metrics
from rulewell.operators.reshape import attach_by_key
from rulewell.operators.scoring import predict_batches


def score_rows(df: DataFrame, model: Callable[[], Any], key: str = "row_id", batch_size: int = 24) -> DataFrame:
    """Prompt every row, run the model, and put the scores back on the rows."""
    asked = df.withColumn("prompt", prompts.chatml(prompts.chat_xml(served=True)))
    return attach_by_key(df, predict_batches(asked, model, key, ["prompt"], batch_size), key)


def score_metrics(scored: DataFrame, truth: str = "violates_rule") -> DataFrame:
    """Metrics of the violation flag against a messy label; rows without a usable label drop out."""
    known = scored.select(
        labels.yes_no_to_int(labels.or_unknown(truth)).alias("truth"),
        F.col("is_violation").cast("int").alias("prediction"),
    ).na.drop(subset=["truth"])
    return binary_metrics(known, "truth", "prediction")
