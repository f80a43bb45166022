"""The corpus pipeline: documents in, packed training sequences out.

Stages, in order; each takes (spark, docs, sf_dir), works on all that the one before kept, is written
as Parquet and read again:

1. quality classifier: documents it rejects go;
2. toxicity: documents it rejects go;
3. line dedup: lines found in ten documents or more lose all their places; the text and n_chars change,
   a document that loses all its lines stays with an empty text;
4. n-gram Jaccard join: of each group of near duplicates (five words, similarity 0.8) the document
   with the smallest doc_id stays;
5. best-fit packing: one row per piece of a document, with its place in a sequence.

Both classifiers learn from the labelled rows of the given documents outside their held-out folds.
The stages handle ties as their operators do; all but the last return the columns of their input, whatever
their names. Null texts are scored as empty ones; a kept one leaves the third stage as an empty text and is nobody's
near duplicate. Repeated rows are judged alike and become one row in the fourth stage; rows that share a number but
not their text, and rows without a number, all stay there. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewell.llm import jaccard_join, line_dedup, packing, quality_classifier, toxicity
from rulewell.llm.common import table
from rulewell.session import ship_package, written

MIN_DOCUMENTS = 10

# Trained models and a tokenizer's merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def _shielded(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` on documents whose other columns have names that none of its own can clash with."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    hidden = {c: f"column {i}" for i, c in enumerate(others)}
    done = stage(docs.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in docs.columns]))
    return done.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _shielded(docs, lambda rows: quality_classifier.score(rows, model, "score").where(F.col("score") >= quality_classifier.THRESHOLD))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _shielded(docs, lambda rows: toxicity.score(rows, model, "score").where(F.col("score") < toxicity.THRESHOLD))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def stage(rows: DataFrame) -> DataFrame:
        bitmaps = line_dedup.drop_bitmaps(rows, MIN_DOCUMENTS, keep_first=False)
        kept = line_dedup.with_kept_text(rows, bitmaps, "kept").withColumn("text", F.col("kept"))
        return kept.withColumn("n_chars", F.length("kept").cast("long")) if "n_chars" in rows.columns else kept

    return _shielded(docs, stage)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _shielded(docs, lambda rows: jaccard_join.one_of_each(rows, size=5, percent=80))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each but the last written and read again."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
