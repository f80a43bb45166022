from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names could clash."""

    def make(rows, partitions=3):
        frame = spark.createDataFrame(rows, DOCS).repartition(partitions)
        extra = {name: "'x'" for name in ("lang", "source", "score", "n", "words", "token", "pos", "m", "host", "__text")}
        return frame.selectExpr("*", *[f"{v} as `{k}`" for k, v in extra.items()])

    return make
