"""CSV files with line feeds inside quoted text, read by many tasks.

A reader that parses such a file from its start is one task, as only the quotes before a place tell whether a line
feed there ends a record. Here lines are read by splits. A first pass counts quotes per split; the parity of all
splits before says whether a split begins inside quotes. In the second pass every task puts the lines of its
splits together to records; only records that cross a split are put together by a shuffle. Whole records go to
``from_csv``.

A quote opens or closes a quoted field or is doubled inside one, as CSV writers have it; a file with stray single
quotes in unquoted fields belongs to ``csv_scan``. A file whose quotes do not pair up raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Splits that begin inside quotes, of which every task gets the list; more of them are read by whole files.
SPLIT_LIMIT = 100_000

_PIECE = "path string, start long, place long, kind int, text string"
HEAD, WHOLE, OPEN = 0, 1, 2  # what continues an earlier record, whole records, and one that goes on


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, line): the lines of every split in order; a split is known by the offset where it starts."""
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.col("value").alias("line"))


def _splits(lines: DataFrame) -> DataFrame:
    """(path, start, inside): whether a split begins inside quotes."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counts = lines.groupBy("path", "start").agg((F.sum(quotes) % 2).alias("odd"))
    order = Window.partitionBy("path").orderBy("start")
    before = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    whole = F.sum("odd").over(Window.partitionBy("path")) % 2
    return counts.select("path", "start", (before == 1).alias("inside"), (whole == 1).alias("unpaired"))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, place, text) of every record of the files, headers included; empty lines are none.

    A record is known by the split that it starts in and its place there.
    """
    lines = _lines(spark, path)
    splits = _splits(lines)
    bad = splits.filter("unpaired").select("path").limit(1).collect()
    if bad:
        raise ValueError(f"quotes of {bad[0]['path']} do not pair up")
    odd = splits.filter("inside").select("path", "start").limit(SPLIT_LIMIT + 1).collect()
    if len(odd) > SPLIT_LIMIT:
        raise ValueError("too many splits begin inside quotes; read the files whole")
    inside = {(r["path"], r["start"]) for r in odd}

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, held, quoted, place, kind = None, [], False, 0, WHOLE

        def piece(kind: int) -> tuple:
            return (*split, place, kind, "\n".join(held))

        for batch in batches:
            out = []
            for name, start, line in zip(batch["path"], batch["start"].tolist(), batch["line"], strict=True):
                if (name, start) != split:
                    if held:
                        out.append(piece(HEAD if kind == HEAD else OPEN))
                    split, held, place = (name, start), [], 0
                    quoted = split in inside
                    kind = HEAD if quoted else WHOLE
                held.append(line)
                quoted ^= line.count('"') % 2 == 1
                if not quoted:
                    if kind == HEAD or held != [""] and held != ["\r"]:
                        out.append(piece(kind))
                    held, place, kind = [], place + 1, WHOLE
            yield pd.DataFrame(out, columns=["path", "start", "place", "kind", "text"])
        if held:
            yield pd.DataFrame([piece(HEAD if kind == HEAD else OPEN)], columns=["path", "start", "place", "kind", "text"])

    pieces = lines.mapInPandas(gather, _PIECE)
    whole = pieces.filter(F.col("kind") == WHOLE)
    # A record that crosses splits begins with an open piece; the heads of the next splits follow it.
    cut = pieces.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("path").orderBy("start", "place")
    opened = F.when(F.col("kind") == OPEN, F.struct("start", "place"))
    owned = cut.withColumn("owner", F.last(opened, ignorenulls=True).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "text"))), lambda x: x["text"])
    joined = owned.groupBy("path", "owner").agg(F.array_join(parts, "\n").alias("text"))
    both = whole.select("path", "start", "place", "text").unionByName(joined.select("path", "owner.start", "owner.place", "text"))
    return both.withColumn("text", F.regexp_replace("text", "\r$", ""))


def split_csv_scan(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """The rows of ``csv_scan``, read by splits. Every file begins with the same header, or the scan fails."""
    from rulewell.sources.csvfiles import READ_OPTIONS, null_texts

    reader = spark.read.options(**READ_OPTIONS)
    try:
        names = reader.csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no input file matches {path}") from error
        raise
    if schema is not None and [f.name for f in schema.fields] != names:
        raise ValueError(f"the header is {names}, not {schema.names}")
    kind = schema or T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {k: v for k, v in READ_OPTIONS.items() if k != "header"}
    found = records(spark, path)
    texts = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    header = F.array(*[F.from_csv("text", texts.simpleString()[7:-1].replace(":", " "), options)[f"c{i}"] for i in range(len(names))])
    first = (F.col("start") == 0) & (F.col("place") == 0)
    same = F.when(~first, True).when(header == F.array(*[F.lit(n) for n in names]), False).otherwise(
        F.raise_error(F.concat(F.lit("another header in "), F.col("path"))).cast("boolean")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)
    parsed = found.filter(same).select(F.from_csv("text", fields, options).alias("r"))
    return null_texts(parsed.select("r.*"))
