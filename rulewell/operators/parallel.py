"""Parallelism for inputs that come in fewer pieces than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Session option: deal inputs out to so many partitions. Unset, scans stay as they are split.
INPUT_PARTITIONS = "spark.rulewell.inputPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to the number of partitions that the caller has set, if any.

    For inputs whose scan cannot be split (one row group, a multi-line CSV file) in front of parsing,
    tokenising and Python work. Sizes of tables play no part.
    """
    wanted = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df
