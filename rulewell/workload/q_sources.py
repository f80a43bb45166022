"""Scans, sources and sinks. Files are written from the tables first, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewell.functions.text import word_count
from rulewell.operators.numbering import number_rows
from rulewell.operators.reshape import stack
from rulewell.schemas import GENERATION_COLUMNS, GENERATION_RENAMED, TRAINING, TRAINING_COLUMNS
from rulewell.sources import checkpointed, corpus, csvfiles, vector_index
from rulewell.sources.splitcsv import split_csv_scan
from rulewell.streaming.ingest import ingest_available
from rulewell.workload.registry import query
from rulewell.workload.sqltext import dot_sql
from rulewell.workload.tables import Tables, sql

_TRAINING_SQL = ", ".join(TRAINING_COLUMNS)
_KEYED = T.StructType([T.StructField("row_id", T.LongType()), *TRAINING.fields])


@query("a01_csv_scan", sql(f"select row_id, {_TRAINING_SQL} from train"))
def csv_scan(t: Tables) -> DataFrame:
    path = t.scratch("csv")
    csvfiles.write_csv(t.train.select("row_id", *TRAINING_COLUMNS), path)
    return split_csv_scan(t.spark, path, _KEYED)


@query(
    "a02_glob_union",
    sql(
        "select row_id, rule, test_comment, violates_rule from train union all "
        "select row_id, rule, test_comment, null from test"
    ),
)
def glob_union(t: Tables) -> DataFrame:
    base = t.scratch("batches")
    csvfiles.write_csv(t.train_with().select("row_id", "rule", "test_comment", "violates_rule"), f"{base}/train_1")
    csvfiles.write_csv(t.test_with().select("row_id", "rule", "test_comment"), f"{base}/more_1")
    both = csvfiles.glob_union(t.spark, [f"{base}/*train*/*.csv", f"{base}/*more*/*.csv"])
    return both.withColumn("row_id", F.col("row_id").cast("long"))


@query("a03_require_columns", sql(f"select row_id, {_TRAINING_SQL} from wide"))
def require_columns(t: Tables) -> DataFrame:
    return csvfiles.require_columns(t.wide, ["row_id", *TRAINING_COLUMNS])


def _generation(t: Tables) -> DataFrame:
    """Training rows in the shape of a raw generation batch."""
    raw = F.concat(F.lit("Violates Rule: "), F.coalesce("violates_rule", F.lit("")))
    values = ["subreddit", "rule", "rule", "positive_example_1", "negative_example_1", "positive_example_2"]
    values += ["negative_example_2", "test_comment", "violates_rule"]
    columns = [F.col(v) for v in values] + [raw, F.lit(None).cast("string")]
    return t.train.select(*[c.alias(n) for c, n in zip(columns, GENERATION_COLUMNS)])


@query("a04_positional_rename", sql(f"select {_TRAINING_SQL} from train"))
def positional_rename(t: Tables) -> DataFrame:
    return csvfiles.rename_by_position(_generation(t), GENERATION_RENAMED, TRAINING_COLUMNS)


@query(
    "a05_file_provenance",
    sql("select string_agg(subreddit, '-' order by subreddit) as run_tag from communities"),
)
def file_provenance(t: Tables) -> DataFrame:
    path = t.scratch("tagged")
    named = t.comments.withColumn("file", F.concat(F.lit("batch_"), F.col("subreddit"), F.lit("_rows")))
    named.select("file", "row_id").write.partitionBy("file").options(**csvfiles.WRITE_OPTIONS).csv(path)
    folders = csvfiles.input_files(t.spark, f"{path}/*/*.csv").select(
        F.element_at(F.split("path", "/"), -2).alias("file_name")
    )
    return csvfiles.run_tag(folders.distinct())


@query("a06_submission_sink", sql("select row_id, rule_violation from train"))
def submission_sink(t: Tables) -> DataFrame:
    path = t.scratch("submission")
    csvfiles.write_submission(t.train_with(), path)
    return csvfiles.csv_scan(t.spark, path, T.StructType.fromDDL("row_id long, rule_violation int"))


@query(
    "a07_corpus_store",
    sql(
        f"""select query_id, row_id, rule, value, round(s, 6) as similarity, r as rank from (
        select a.row_id as query_id, b.row_id, b.rule, b.value, {dot_sql('a.embedding', 'b.embedding')} as s,
        cast(row_number() over (partition by a.row_id order by {dot_sql('a.embedding', 'b.embedding')} desc, b.row_id) as int) as r
        from corpus a join corpus b on a.rule = b.rule where a.row_id % 50 = 0) z where r <= 5"""
    ),
)
def corpus_store(t: Tables) -> DataFrame:
    """Fresh questions, every fiftieth vector, to the whole stored corpus and its stored index."""
    path = t.scratch("corpus")
    corpus.save_corpus(t.corpus, f"{path}/rows")
    vector_index.build_index(corpus.load_corpus(t.spark, f"{path}/rows"), f"{path}/index", group="rule", carry=("value",))
    asked = t.corpus.filter("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), F.col("rule").alias("matched_rule"), "embedding")
    found = vector_index.open_index(t.spark, f"{path}/index").search(asked, 5, query_group="matched_rule")
    rules = asked.select("query_id", F.col("matched_rule").alias("rule"))
    return found.join(rules, "query_id").select("query_id", "row_id", "rule", "value", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "a08_batch_checkpoint_sink",
    sql(
        r"""select row_id, cast((row_number() over (order by row_id) - 1) // 200 as bigint) as batch_id,
        len(regexp_extract_all(test_comment, '\S+')) as words from wide"""
    ),
)
def batch_checkpoint_sink(t: Tables) -> DataFrame:
    batches = number_rows(t.wide_with().select("row_id", "test_comment"), "row_id").selectExpr(
        "row_id", "test_comment", "rn div 200 AS batch_id"
    )
    path = t.scratch("processed")

    def work(rows: DataFrame) -> DataFrame:
        return rows.select("row_id", "batch_id", word_count("test_comment").alias("words"))

    checkpointed.process_batches(batches, work, path)
    # The second call finds every batch recorded and only reads.
    again = checkpointed.process_batches(batches, work, path)
    return again.select("row_id", F.col("batch_id").cast("long").alias("batch_id"), "words")


@query(
    "a09_batch_ingest_stream",
    sql(
        f"select {_TRAINING_SQL} from train where {' and '.join(c + ' is not null' for c in TRAINING_COLUMNS)}"
    ),
)
def batch_ingest_stream(t: Tables) -> DataFrame:
    base = t.scratch("stream")
    csvfiles.write_csv(_generation(t), f"{base}/incoming")
    ingest_available(t.spark, f"{base}/incoming", f"{base}/table", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/table")


@query(
    "a10_derived_lists",
    sql(
        "select 'rule' as kind, rule as value from wide where rule is not null group by rule union all "
        "select distinct 'community', subreddit from (select subreddit, row_number() over (partition by rule order by row_id) r "
        "from wide where rule is not null) z where r = 1"
    ),
)
def derived_lists(t: Tables) -> DataFrame:
    base = t.scratch("lists")
    csvfiles.write_csv(csvfiles.rule_list(t.wide_with().select("row_id", "rule"), "rule", ["row_id"]), f"{base}/rules")
    communities = csvfiles.community_list(t.wide_with().select("row_id", "rule", "subreddit"), "rule", "subreddit", ["row_id"])
    csvfiles.write_csv(communities, f"{base}/communities")
    rules = csvfiles.csv_scan(t.spark, f"{base}/rules").select(F.lit("rule").alias("kind"), F.col("rule").alias("value"))
    names = csvfiles.csv_scan(t.spark, f"{base}/communities")
    return stack(rules, names.select(F.lit("community").alias("kind"), F.col("subreddit").alias("value")))


