"""Stored corpora: rows, vectors and the rule mapping as one Parquet dataset."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION_COLUMNS = ("n_buckets", "rule_bucket")


def save_corpus(corpus: DataFrame, path: str, n_buckets: int = 64, rule: str = "rule") -> None:
    """Write the corpus partitioned by a stable hash of the rule.

    The rebalance hint lets adaptive execution merge small buckets and split a bucket that one
    rule has made large over several writers.
    """
    placed = corpus.withColumn("n_buckets", F.lit(n_buckets)).withColumn(
        "rule_bucket", F.pmod(F.xxhash64(rule), F.lit(n_buckets)).cast("int")
    )
    placed.hint("rebalance", "rule_bucket").write.mode("overwrite").partitionBy(*PARTITION_COLUMNS).parquet(path)


def load_corpus(spark: SparkSession, path: str, rules: Sequence[str] | None = None, rule: str = "rule") -> DataFrame:
    """Read a corpus back; with ``rules`` only their buckets are scanned."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no stored corpus at {path}") from error
        raise
    if rules is not None:
        bucket = F.col("rule_bucket")
        wanted = [bucket == F.pmod(F.xxhash64(F.lit(r)), F.col("n_buckets")) for r in rules]
        stored = stored.filter(reduce(or_, wanted)).filter(F.col(rule).isin(*rules))
    return stored.drop(*PARTITION_COLUMNS)
