"""The moderation tables derived from small rows of their own."""

from __future__ import annotations

import random
import re

import pytest

from rulewell.schemas import EXAMPLE_COLUMNS
from rulewell.workload import tables

# (doc_id, toxic): some without a label, one number below zero, one repeated, one null.
TOXIC = [(i, {0: 1, 1: 0, 2: 0, 3: None}[i % 4]) for i in range(40)] + [(-5, 1), (7, 0), (None, 1)]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("given"))
    docs = [(d, f"text {d} {i}", f"c{i % 3}") for i, (d, _) in enumerate(TOXIC)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    flags = [(d, t) for d, t in TOXIC if d != 7]
    spark.createDataFrame(flags, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    rules = [(i, f"rule\n{i}") for i in range(3)]
    spark.createDataFrame(rules, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def expected():
    docs = [(d, f"text {d} {i}", f"c{i % 3}") for i, (d, _) in enumerate(TOXIC)]
    flags = {d: t for d, t in TOXIC if d is not None and d != 7}
    donors = {label: [t for d, t, _ in sorted((x for x in docs if x[0] is not None and flags.get(x[0]) == label))] for label in (1, 0)}
    out = []
    for d, text, source in docs:
        if d is None or d < 0:
            continue
        pos, neg = donors[1], donors[0]
        bodies = [pos[d % len(pos)], pos[(d + 1) % len(pos)], neg[d % len(neg)], neg[(d + 1) % len(neg)]]
        if d % 31 == 3:
            bodies[0] = None
        out.append((d, source, f"No rule {d % 3}", *bodies, text, flags.get(d)))
    return sorted(out, key=str)


def test_wide_rows(spark, given):
    t = tables.Tables(spark, given)
    assert sorted((tuple(r)[:9] for r in t.wide.collect()), key=str) == expected()


@pytest.mark.parametrize("named", [(), EXAMPLE_COLUMNS[:1], EXAMPLE_COLUMNS[1:3], EXAMPLE_COLUMNS[3:]])
def test_named_examples_only(spark, given, named):
    t = tables.Tables(spark, given)
    got = t.wide_with(*named)
    assert [c for c in got.columns if c in EXAMPLE_COLUMNS] == list(named)
    whole = t.wide.select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_answers_attach_no_examples(spark, given):
    t = tables.Tables(spark, given + "/")
    known = {k: v for k, v in tables._STORED.items() if k[1] == given}
    for key in known:
        del tables._STORED[key]
    assert t.answers.count() == 30
    assert {k[2] for k in tables._STORED if k[1] == given} == {"rules", "sizes"}
    tables._STORED.update(known)


def test_stored_wide_table_is_used(spark, given):
    t = tables.Tables(spark, given)
    before = sorted(map(tuple, t.wide_with("positive_example_2").collect()), key=str)
    t.store_wide()
    kept = t.wide_with("positive_example_2")
    assert "wide-" in kept.inputFiles()[0] and sorted(map(tuple, kept.collect()), key=str) == before
    del tables._STORED[t._key("wide")]


def _dealt_with_comment(df):
    """How many exchanges of the plan carry the rows' texts."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*test_comment", plan))


def test_rows_are_dealt_once_for_all_examples(spark, given):
    t = tables.Tables(spark, given)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bare, whole = _dealt_with_comment(t.wide_with()), _dealt_with_comment(t.wide)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert whole == bare + 1


@pytest.mark.parametrize(("toxic_share", "block", "turns"), [(0.1, 4, 2), (0.9, 3, 1), (0.5, 32, 32)])
def test_examples_of_sparse_numbers(spark, tmp_path, monkeypatch, toxic_share, block, turns):
    monkeypatch.setattr(tables, "BLOCK", block)
    monkeypatch.setattr(tables, "TURNS", turns)
    draw = random.Random(block)
    ids = sorted(draw.sample(range(3000), 120) + list(range(3000, 3100)) + [10**15, 10**15 + 1])
    docs = [(d, None if d % 17 == 0 else f"text {d}", "c") for d in ids]
    flags = {d: int(draw.random() < toxic_share) for d in ids if d % 3}
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(flags.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "r")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pos, neg = ([t for d, t, _ in docs if flags.get(d) == label] for label in (1, 0))
    want = [
        (d, None if d % 31 == 3 else pos[d % len(pos)], pos[(d + 1) % len(pos)], neg[d % len(neg)], neg[(d + 1) % len(neg)], text)
        for d, text, _ in docs
    ]
    got = tables.Tables(spark, str(tmp_path)).wide.select("row_id", *EXAMPLE_COLUMNS, "test_comment")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
