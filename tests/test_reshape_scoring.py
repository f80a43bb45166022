"""Augmentation, scoring, evaluation and profiling."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rulewell.functions import prompts
from rulewell.operators import cleaning, evaluation, profiling, reshape, scoring
from rulewell.schemas import EXAMPLE_COLUMNS
from rulewell.workload.stubs import DigestModel, length_generator

KIND = "row_id long, subreddit string, rule string, positive_example_1 string, positive_example_2 string, negative_example_1 string, negative_example_2 string, test_comment string, violates_rule string"


@pytest.fixture(scope="module")
def wide(spark):
    rows = []
    for i in range(43):
        rule = "hot" if i % 5 else "rare"
        examples = [None if (c.endswith("1") and i % 7 == 0) else f"{c}-{i}" for c in EXAMPLE_COLUMNS]
        rows.append((i, f"s{i % 3}", rule, *examples, f"comment {i}", ["Yes", "No", "maybe"][i % 3]))
    return spark.createDataFrame(rows, KIND).repartition(4).cache()


def test_swap_twice_restores_the_row(wide):
    once = reshape.swap_examples(wide)
    slot = once.filter("swapped = 'positive_example_2'").drop("swapped")
    twice = reshape.swap_examples(slot).filter("swapped = 'positive_example_2'").drop("swapped")
    want = wide.filter("violates_rule = 'Yes'").select(*twice.columns)
    assert set(map(tuple, twice.collect())) == set(map(tuple, want.collect()))
    expected = 0
    for r in wide.collect():
        side = {"Yes": "positive", "No": "negative"}.get(r.violates_rule)
        expected += sum(r[f"{side}_example_{i}"] is not None for i in (1, 2)) if side else 0
    assert once.count() == expected
    assert reshape.with_swaps(wide).count() == 43 + expected


def test_unpivot_keeps_nulls(wide):
    df = wide.withColumn("rule_violation", F.lit(1))
    long = reshape.unpivot_with_main(df, ["row_id"], "test_comment", "rule_violation")
    assert long.count() == 5 * 43 and long.filter("body is null").count() > 0
    assert reshape.unpivot_examples(df, ["row_id"]).count() == 4 * 43


def test_donors(wide):
    got = reshape.donate_examples(wide.withColumn("body", F.lit(""))).collect()
    rows = wide.toPandas().sort_values("row_id")
    expected = {}
    for _, group in rows.groupby("rule"):
        ids = group.row_id.tolist()
        for at in range(0, len(ids) - 4, 5):
            expected.update({i: ids[at + 4] for i in ids[at : at + 4]})
    assert {r.row_id for r in got} == set(expected)
    by_id = rows.set_index("row_id")
    for donor in set(expected.values()):
        bodies = [r.body for r in got if expected[r.row_id] == donor]
        offered = [by_id.loc[donor, c] for c in EXAMPLE_COLUMNS]
        assert sorted(map(str, bodies)) == sorted(map(str, offered))


def test_dedupe_and_conflicts(spark):
    train = spark.createDataFrame([(1, "r", "s", "same", 0), (2, "r", "s", "other", 1)], "row_id long, rule string, subreddit string, body string, rule_violation int")
    test = spark.createDataFrame([(9, "r", "s", "same", " ", "new", None)], "row_id long, rule string, subreddit string, positive_example_1 string, positive_example_2 string, negative_example_1 string, negative_example_2 string")
    got = {r.body: r.rule_violation for r in reshape.combine_dedupe(train, test).collect()}
    assert got == {"same": 0, "other": 1, "new": 0}


def test_pairs(spark):
    subs = spark.createDataFrame([(i * 3, f"s{i}") for i in range(7)], "id long, subreddit string")
    rules = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "id long, rule string")
    every = reshape.community_rule_pairs(subs, rules, None)
    assert every.select("subreddit", "rule").distinct().count() == 35 == every.count()
    some = reshape.community_rule_pairs(subs, rules, 20)
    assert some.select("subreddit", "rule").distinct().count() == 20 == some.count()
    assert reshape.community_rule_pairs(subs, rules, 99).select("subreddit", "rule").distinct().count() == 35
    assert reshape.random_pairs(subs, rules, 60).count() == 60


def test_first_seen_and_audit(spark):
    df = spark.createDataFrame([(3, "A"), (1, "a"), (2, None), (4, None)], "i long, name string")
    assert {r.i for r in cleaning.first_seen(df, "name", ["i"]).collect()} == {1, 2}
    audit = cleaning.null_audit(df, ["i", "name"]).collect()
    assert {(r.column_name, r.dropped_rows, r.rows_before, r.rows_after) for r in audit} == {("i", 0, 4, 2), ("name", 2, 4, 2)}


def test_only_the_failing_batch_has_error_rows(spark):
    df = spark.range(100).select(F.col("id").alias("row_id")).repartition(7)
    scored = scoring.predict_batches(df, DigestModel, "row_id", [], batch_size=12).toPandas()
    assert sorted(scored.row_id) == list(range(100))
    first = {b: part.row_id.min() for b, part in scored.groupby("batch_number")}
    for b, part in scored.groupby("batch_number"):
        assert part.row_id.tolist() == list(range((b - 1) * 12, min(b * 12, 100)))
        failed = first[b] % 7 == 3
        assert set(part.batch_error) == {failed}
        if failed:
            assert set(part.prediction) == {"Error"} and set(part.error) == {f"Batch {b} failed: unusable batch"}
    report = scoring.failed_batches(spark.createDataFrame(scored), "row_id").collect()
    assert {r.batch_number for r in report} == {b for b in first if first[b] % 7 == 3}


def test_adapter_is_forwarded(spark):
    df = spark.range(5).select(F.col("id").alias("row_id"))
    plain = scoring.predict_batches(df, DigestModel, "row_id", []).toPandas().violation_probability
    tuned = scoring.predict_batches(df, DigestModel, "row_id", [], adapter="v1").toPandas().violation_probability
    assert plain.tolist() != tuned.tolist()


def test_batches_survive_arrow_cuts():
    frame = pd.DataFrame({"batch_number": [1] * 5 + [2] * 5 + [4] * 2, "x": range(12)})
    cuts = [frame[:3], frame[3:7], frame[7:11], frame[11:]]
    got = [(n, part.x.tolist()) for n, part in scoring._logical_batches(iter(cuts))]
    assert got == [(1, [0, 1, 2, 3, 4]), (2, [5, 6, 7, 8, 9]), (4, [10, 11])]


def test_generator_errors_stay_on_their_rows(spark):
    df = spark.range(40).select(F.col("id").alias("k"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("p"))
    got = {r.k: r for r in scoring.generate_batches(df, length_generator, "k", "p", 7).collect()}
    assert got[13].error == "quota exceeded" and got[13].response is None
    assert got[11].error is None and got[11].response is None
    assert got[12].response == "Formatted Rule: 12\nViolates Rule: No"


def test_metrics_against_counting(spark):
    rows = [(i % 2, int(i % 3 == 0)) for i in range(25)] + [(None, 1), (1, None)]
    df = spark.createDataFrame(rows, "t int, p int")
    m = evaluation.binary_metrics(df, "t", "p").first()
    tp = sum(a == 1 and b == 1 for a, b in rows)
    fp = sum(a == 0 and b == 1 for a, b in rows)
    fn = sum(a == 1 and b == 0 for a, b in rows)
    assert (m.tp, m.fp, m.fn, m.tn) == (tp, fp, fn, 25 - tp - fp - fn)
    assert m.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
    report = {r.label: r for r in evaluation.class_report(df, "t", "p").collect()}
    assert report["macro avg"].f1 == pytest.approx((report["No Violation"].f1 + report["Violation"].f1) / 2)
    assert report["weighted avg"].support == 25
    nothing = evaluation.coverage_summary(df.select(F.lit("x").alias("t"), F.lit("Error").alias("p")), "t", "p").first()
    assert (nothing.valid_rows, nothing.f1, nothing.success_rate) == (0, 0.0, 0.0)
    assert evaluation.coverage_report(df.select(F.lit("x").alias("t"), F.lit("yes").alias("p")), "t", "p").count() == 0


def test_histogram_and_distinct(spark):
    df = spark.createDataFrame([("a b c", "x"), ("a", "x"), (None, None), ("a b", "y")], "c string, d string")
    bins = {r.bin: r.frequency for r in profiling.word_histogram(df, ["c"], 4).collect()}
    assert bins == {0: 2, 2: 1, 3: 1}
    assert {(r.column_name, r.distinct_values) for r in profiling.distinct_counts(df, ["c", "d"]).collect()} == {("c", 3), ("d", 2)}
    tags = spark.createDataFrame([(1, "Clear"), (2, "Unclear"), (3, "Unclear")], "k long, clarity_tag string")
    assert profiling.clarity_counts(tags).first() == (1, 2)
    assert [r.k for r in profiling.unclear_rows(tags, "k", 1).collect()] == [2]


def test_prompt_forms(wide):
    row = wide.filter("row_id = 7").select(
        prompts.chat_xml(F.col("violates_rule")).alias("train"),
        prompts.chat_xml(served=True).alias("served"),
        prompts.quote_lines(F.lit("a\nb")).alias("quoted"),
        prompts.chatml(prompts.chat_interleaved()).alias("chatml"),
        prompts.classifier_text().alias("c1"),
        prompts.classifier_text(served=True).alias("c2"),
    ).first()
    assert [m.role for m in row.train] == ["system", "user", "assistant"]
    assert row.train[1].content.startswith("<rule>\nhot\n</rule>\n\n<examples>")
    assert row.served[1].content.startswith("<rule>\n    hot\n    </rule>\n    <examples>\n    <example>\n    <comment>nan</comment>")
    assert row.quoted == "| a\n| b"
    assert row.chatml.startswith("<|im_start|>system\nYou are") and row.chatml.endswith("comment 7<|im_end|>")
    assert len(row.c2) == len(row.c1) + 1
