"""Batch-wise processing that can be stopped and run again, with a typed commit log.

A store has three tables, and every run writes a folder of its own in each: ``rows`` (the output),
``done`` (the numbers of the input's batches) and, last, ``commits`` (one row: the run, when, and the types of
its numbers and output). Only what a commit names is ever read, with the types that the commit states, so what
broken or unfinished runs leave behind has no effect, and no reader guesses types from one file. Writers
share no folder. Where two of them did the same batch, the earlier commit has it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewell.session import written

SLOTS = 256
_COMMIT = "run string, at timestamp, id_type string, columns string"


class _Store:
    """The committed part of a store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.commits = self._read("commits", _COMMIT)
        # The log: a short row a run.
        self.runs = [] if self.commits is None else [r["run"] for r in self.commits.select("run").collect()]
        kinds = [] if self.commits is None else self.commits.select("id_type", "columns").distinct().limit(2).collect()
        if len(kinds) > 1:
            raise ValueError(f"{path} holds runs of different types")
        self.id_type = T.StructType.fromJson(json.loads(kinds[0]["id_type"]))["batch_id"].dataType if kinds else None
        self.columns = T.StructType.fromJson(json.loads(kinds[0]["columns"])) if kinds else None

    def _read(self, name: str, schema: str | T.StructType, runs: list[str] | None = None) -> DataFrame | None:
        """A table of the store; with ``runs`` the folders of those alone, whatever else lies beside them."""
        base = f"{self.path}/{name}"
        folders = [base] if runs is None else [f"{base}/run={run}" for run in runs]
        try:
            return self.spark.read.schema(schema).option("basePath", base).parquet(*folders)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def owners(self) -> DataFrame:
        """(batch_id, run): every batch that is done, with the run whose output counts."""
        schema = T.StructType([T.StructField("batch_id", self.id_type), T.StructField("run", T.StringType())])
        done = self._read("done", schema, self.runs).join(self.commits.select("run", "at"), "run")
        first = done.groupBy("batch_id").agg(F.min(F.struct("at", "run")).alias("first"))
        return first.select("batch_id", F.col("first.run").alias("run"))

    def rows(self) -> DataFrame:
        schema = T.StructType([*self.columns.fields, T.StructField("run", T.StringType())])
        return self._read("rows", schema, self.runs).join(self.owners(), ["batch_id", "run"], "left_semi").select(*self.columns.names)

    def commit(self, run: str, rows: DataFrame, batches: DataFrame, slots: int) -> None:
        slot = F.pmod(F.xxhash64("batch_id"), F.lit(slots)).cast("int")
        rows.withColumn("__slot", slot).write.partitionBy("__slot").parquet(f"{self.path}/rows/run={run}")
        batches.write.parquet(f"{self.path}/done/run={run}")
        kind, columns = (json.dumps(_plain(d.schema).jsonValue()) for d in (batches, rows))
        note = self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(kind).alias("id_type"), F.lit(columns).alias("columns"))
        note.coalesce(1).write.parquet(f"{self.path}/commits/run={run}")


def _plain(schema: T.StructType) -> T.StructType:
    """Names and types without what does not matter to a reader: nullability and comments, in name order."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in sorted(schema.fields, key=lambda f: f.name)])


def _typed(df: DataFrame, store: _Store) -> DataFrame:
    """The rows with their batch numbers in the store's type; whole numbers of any width are kept as BIGINT.

    A type that is not the store's raises TypeError before anything is written.
    """
    given = df.schema["batch_id"].dataType
    stored = T.LongType() if isinstance(given, T.IntegralType) else given
    if store.id_type is not None and stored != store.id_type:
        raise TypeError(f"batches under {store.path} are numbered by {store.id_type.simpleString()}, not {given.simpleString()}")
    return df.withColumn("batch_id", F.col("batch_id").cast(stored))


def pending_rows(df: DataFrame, path: str) -> DataFrame:
    """Rows of batches not yet recorded as done under ``path``."""
    store = _Store(df.sparkSession, path)
    typed = _typed(df, store)
    return typed if store.commits is None else typed.join(store.owners(), "batch_id", "left_anti")


def process_batches(
    df: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, slots: int = SLOTS, waves: int = 1
) -> DataFrame:
    """Process rows by their ``batch_id`` and store the output; returns all recorded output.

    The pending input is written once, so that what is processed and what is recorded are the same
    rows. ``process`` keeps the ``batch_id`` of its rows; its output has the same columns in every run, or ValueError
    is raised before anything is stored. A batch without output is done as well. Any kind of batch
    number will do, however sparse, but not null; whole numbers reach ``process`` as BIGINT. ``waves``
    cuts the written input into so many hash slices of batches that are processed and recorded one
    after the other, for callers whose model calls are too dear to lose a whole run.
    """
    spark = df.sparkSession
    todo = written(pending_rows(df, path), "pending")
    if not todo.filter(F.col("batch_id").isNull()).isEmpty():
        raise ValueError("rows without a batch_id")
    for wave in range(0 if todo.isEmpty() else waves):
        part = todo.filter(F.pmod(F.xxhash64("batch_id", F.lit(5)), F.lit(waves)) == wave) if waves > 1 else todo
        out, store = process(part), _Store(spark, path)
        if store.columns is not None and _plain(out.schema).simpleString() != store.columns.simpleString():
            raise ValueError(f"output of {path} is {store.columns.simpleString()}, not {_plain(out.schema).simpleString()}")
        store.commit(uuid.uuid4().hex, out, part.select("batch_id").distinct(), slots)
    store = _Store(spark, path)
    return process(todo).limit(0) if store.commits is None else store.rows()
