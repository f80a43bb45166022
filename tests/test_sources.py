"""Files in and out: scans, checks, stored corpora, resumable batches, streaming."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rulewell.plans.assemble import clean_generation, training_table
from rulewell.plans.generate import fewshot_requests, run_generation
from rulewell.plans.score import score_metrics, score_rows
from rulewell.schemas import GENERATION_BATCH, GENERATION_COLUMNS, TRAINING, TRAINING_COLUMNS
from rulewell.sources import checkpointed, corpus, csvfiles
from rulewell.streaming.ingest import ingest_available
from rulewell.workload.stubs import DigestModel, length_generator


def training_rows(spark, n, start=0):
    rows = [
        (f"s{i % 2}", f"rule {i % 3}", f"p1 {i}", f'n1 "q" {i}\nline, two ', f"p2 {i}", None if i % 4 == 3 else f"n2 {i}", f" c {i}", ["True", '"No"', "maybe", "NA"][i % 4])
        for i in range(start, start + n)
    ]
    return spark.createDataFrame(rows, TRAINING)


def test_csv_round_trip_and_null_texts(spark, tmp_path):
    df = training_rows(spark, 8)
    csvfiles.write_csv(df, str(tmp_path / "t"))
    back = csvfiles.csv_scan(spark, str(tmp_path / "t"), TRAINING)
    want = {tuple(None if v == "NA" else v for v in r) for r in df.collect()}
    assert set(map(tuple, back.collect())) == want
    with pytest.raises(FileNotFoundError):
        csvfiles.csv_scan(spark, str(tmp_path / "absent"))


def test_glob_union_excludes_and_rejects(spark, tmp_path):
    for name in ("batch_2_train.csv", "batch_1_train.csv", "df_test_train.csv"):
        training_rows(spark, 3).toPandas().to_csv(tmp_path / name, index=False)
    both = csvfiles.glob_union(spark, [f"{tmp_path}/*train*.csv"], TRAINING)
    assert both.count() == 9
    assert csvfiles.glob_union(spark, [f"{tmp_path}/*train*.csv"], TRAINING, exclude="df_test_train.csv").count() == 6
    with pytest.raises(ValueError, match="both patterns"):
        csvfiles.reject_overlap(spark, f"{tmp_path}/*train*.csv", f"{tmp_path}/*test*.csv")
    csvfiles.reject_overlap(spark, f"{tmp_path}/batch*.csv", f"{tmp_path}/*test*.csv")
    tag = csvfiles.run_tag(csvfiles.input_files(spark, f"{tmp_path}/batch*.csv")).first()
    assert tag.run_tag == "1-2"
    assert csvfiles.run_tag(csvfiles.input_files(spark, f"{tmp_path}/df*.csv")).first().run_tag is None
    with pytest.raises(ValueError, match="missing required"):
        csvfiles.require_columns(both, ["rule", "nope"])
    cleaned = training_table(spark, [f"{tmp_path}/batch*.csv"])
    assert {r.violates_rule for r in cleaned.collect()} == {"Yes", "No"} and cleaned.count() == 4


def test_corpus_store_prunes_buckets(spark, tmp_path):
    df = spark.range(200).select(
        F.col("id").alias("row_id"), F.concat(F.lit("rule "), (F.col("id") % 9).cast("string")).alias("rule"), F.lit(1).alias("value")
    )
    corpus.save_corpus(df, str(tmp_path / "c"), n_buckets=8)
    assert corpus.load_corpus(spark, str(tmp_path / "c")).count() == 200
    some = corpus.load_corpus(spark, str(tmp_path / "c"), rules=["rule 1", "rule 4"])
    assert {r.rule for r in some.select("rule").distinct().collect()} == {"rule 1", "rule 4"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in plan or "PartitionFilters: [isnotnull" in plan
    with pytest.raises(FileNotFoundError):
        corpus.load_corpus(spark, str(tmp_path / "absent"))


def test_batches_resume_where_they_stopped(spark, tmp_path):
    path = str(tmp_path / "b")
    df = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") / 10).cast("int").alias("batch_id"))
    double = lambda rows: rows.withColumn("twice", F.col("row_id") * 2)

    def breaks(rows):
        return double(rows).withColumn("x", F.when(F.col("batch_id") == 3, F.raise_error(F.lit("stop"))).cast("int")).drop("x").filter(
            F.when(F.col("batch_id") == 3, F.raise_error(F.lit("stop")).cast("boolean")).otherwise(F.lit(True))
        )

    with pytest.raises(Exception, match="stop"):
        checkpointed.process_batches(df, breaks, path, waves=5)
    left = {r.batch_id for r in checkpointed.pending_rows(df, path).select("batch_id").distinct().collect()}
    assert 3 in left and left <= {0, 1, 2, 3, 4}
    out = checkpointed.process_batches(df, double, path)
    assert sorted(r.twice for r in out.collect()) == [2 * i for i in range(50)]
    assert checkpointed.pending_rows(df, path).count() == 0


def test_batches_without_output_are_done_once(spark, tmp_path):
    path, seen = str(tmp_path / "b"), []
    ids = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.lit(9_000_000_000_000))
    df = spark.range(20).select(F.col("id").alias("row_id"), ids.alias("batch_id"))

    def odd_only(rows):
        seen.append(sorted(r.batch_id for r in rows.select("batch_id").distinct().collect()))
        return rows.filter("row_id % 2 = 1")

    assert checkpointed.process_batches(df, odd_only, path).count() == 10
    assert checkpointed.process_batches(df, odd_only, path).count() == 10
    assert seen == [[7, 9_000_000_000_000]]
    more = df.withColumn("batch_id", F.lit(8))
    assert checkpointed.process_batches(more, lambda rows: rows.limit(0), path).count() == 10
    assert checkpointed.pending_rows(more, path).count() == 0


def batches_of(spark, kind, *numbers):
    rows = spark.createDataFrame([(i, i % 7) for i in numbers], "batch_id long, x long")
    return rows.withColumn("batch_id", F.col("batch_id").cast(kind))


def test_width_of_numbers_does_not_matter_and_their_kind_does(spark, tmp_path):
    path = str(tmp_path / "b")
    same = lambda rows: rows
    assert checkpointed.process_batches(batches_of(spark, "int", 1, 2), same, path).count() == 2
    assert checkpointed.process_batches(batches_of(spark, "long", 2, 9_000_000_000_000), same, path).count() == 3
    out = checkpointed.process_batches(batches_of(spark, "smallint", 3), same, path)
    assert sorted(r.batch_id for r in out.collect()) == [1, 2, 3, 9_000_000_000_000]
    before = sorted(str(p) for p in (tmp_path / "b").rglob("*"))
    with pytest.raises(TypeError, match="numbered by bigint, not string"):
        checkpointed.process_batches(batches_of(spark, "string", 4), same, path)
    with pytest.raises(ValueError, match="without a batch_id"):
        checkpointed.process_batches(batches_of(spark, "long", 5).withColumn("batch_id", F.lit(None).cast("long")), same, path)
    with pytest.raises(ValueError, match="output of"):
        checkpointed.process_batches(batches_of(spark, "long", 6), lambda rows: rows.withColumn("x", F.lit("a")), path)
    assert sorted(str(p) for p in (tmp_path / "b").rglob("*")) == before


def test_text_numbers_keep_their_type(spark, tmp_path):
    path = str(tmp_path / "b")
    out = checkpointed.process_batches(batches_of(spark, "string", 7, 8), lambda rows: rows, path)
    assert out.schema["batch_id"].dataType.simpleString() == "string" and out.count() == 2
    assert checkpointed.pending_rows(batches_of(spark, "string", 8, 9), path).count() == 1


def test_two_writers_of_one_batch_do_not_mix(spark, tmp_path):
    """The second writer begins before the first has committed; its output for the shared batch does not count."""
    path = str(tmp_path / "b")

    def outer(rows):
        checkpointed.process_batches(batches_of(spark, "int", 1, 2), lambda r: r.withColumn("who", F.lit("inner")), path)
        return rows.withColumn("who", F.lit("outer"))

    out = checkpointed.process_batches(batches_of(spark, "long", 2, 3), outer, path)
    assert sorted((r.batch_id, r.who) for r in out.collect()) == [(1, "inner"), (2, "inner"), (3, "outer")]


def test_output_without_a_commit_is_never_read(spark, tmp_path):
    path = str(tmp_path / "b")
    checkpointed.process_batches(batches_of(spark, "int", 1), lambda rows: rows, path)
    left = batches_of(spark, "string", 2)
    left.write.parquet(f"{path}/rows/run=broken/__slot=0")
    left.select("batch_id").write.parquet(f"{path}/done/run=broken")
    assert checkpointed.pending_rows(batches_of(spark, "int", 1, 2), path).count() == 1
    out = checkpointed.process_batches(batches_of(spark, "int", 1, 3), lambda rows: rows, path)
    assert sorted(r.batch_id for r in out.collect()) == [1, 3]


def generation(spark, n, start):
    t = training_rows(spark, n, start)
    values = ["subreddit", "rule", "rule", "positive_example_1", "negative_example_1", "positive_example_2", "negative_example_2", "test_comment", "violates_rule"]
    return t.select(*[F.col(v).alias(c) for v, c in zip(values, GENERATION_COLUMNS)], F.lit("raw").alias("Raw Response"), F.lit(None).cast("string").alias("Error"))


def test_stream_equals_batch_and_is_incremental(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    generation(spark, 6, 0).toPandas().to_csv(tmp_path / "in" / "a.csv", index=False)
    ingest_available(spark, source, target, state)
    first = spark.read.parquet(target).count()
    generation(spark, 5, 6).toPandas().to_csv(tmp_path / "in" / "b.csv", index=False)
    ingest_available(spark, source, target, state)
    batch = clean_generation(csvfiles.csv_scan(spark, source, GENERATION_BATCH))
    streamed = spark.read.parquet(target)
    assert 0 < first < streamed.count()
    assert sorted(map(str, streamed.select(*TRAINING_COLUMNS).collect())) == sorted(map(str, batch.collect()))


def test_scoring_and_generation_plans(spark):
    df = training_rows(spark, 30).withColumn("row_id", F.monotonically_increasing_id())
    scored = score_rows(df, DigestModel)
    assert scored.count() == 30
    m = score_metrics(scored).first()
    assert m.tp + m.fp + m.fn + m.tn == df.filter("""violates_rule = '"No"'""").count()
    subs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, subreddit string")
    rules = spark.createDataFrame([(1, "r1"), (2, "r2")], "id long, rule string")
    requests = fewshot_requests(subs, rules, df, 3)
    made = run_generation(requests, length_generator).collect()
    assert len(made) == 3 and all((r.error is None) == (r.formatted_rule is not None) for r in made)
