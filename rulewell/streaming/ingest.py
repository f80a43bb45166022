"""Incremental ingest of generation batches as they appear in a folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rulewell.plans.assemble import clean_generation
from rulewell.schemas import GENERATION_BATCH
from rulewell.sources.csvfiles import READ_OPTIONS, null_texts


def ingest_available(
    spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int = 1000
) -> None:
    """Clean every batch file not seen before into a Parquet table, then stop.

    The checkpoint remembers the files, so calling this again picks up new ones only; the result
    equals one batch run over all files. The plan is stateless: nothing is kept between batches.
    """
    batches = (
        spark.readStream.schema(GENERATION_BATCH)
        .options(**READ_OPTIONS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(source)
    )
    query = (
        clean_generation(null_texts(batches))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
